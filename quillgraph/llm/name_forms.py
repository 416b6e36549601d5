"""Reading one spelling of a name: person or organisation, surname, given names, initials."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from quillgraph.operators import packed

# Words before and behind a person's name.
TITLES = frozenset("dr prof professor mr mrs ms sir dame rev fr herr frau dipl ing hon docent doc priv doz pd".split())
DEGREES = packed.DEGREES - {"iv", "dr", "prof"}  # these are initials or titles here
PARTICLES = packed.PARTICLES
# Words that make a name an organisation's, with what is written for them.
ORGANISATION = {
    "inst": "institute", "institut": "institute", "institute": "institute", "univ": "university", "uni": "university", "university": "university", "hosp": "hospital", "hsp": "hospital", "hospital": "hospital", "dept": "department", "dpt": "department", "dep": "department", "department": "department",
    "netw": "network", "ntwk": "network", "network": "network", "found": "foundation", "fdn": "foundation", "fnd": "foundation", "foundation": "foundation", "grp": "group", "gr": "group", "group": "group", "cons": "consortium", "consort": "consortium", "consortium": "consortium", "ctr": "centre", "center": "centre", "centre": "centre",
    "soc": "society", "society": "society", "assoc": "association", "association": "association", "lab": "laboratory", "laboratory": "laboratory", "coll": "college", "college": "college", "committee": "committee", "comm": "committee", "registry": "registry", "reg": "registry",
    "investigators": "investigators", "collaboration": "collaboration", "collab": "collaboration", "alliance": "alliance", "agency": "agency", "ministry": "ministry", "clinic": "clinic", "school": "school", "unit": "unit", "council": "council", "trust": "trust", "team": "team", "initiative": "initiative",
}
SHORT = {"neurol": "neurology", "neuro": "neurology", "dis": "diseases", "gen": "genetics", "res": "research", "med": "medicine", "sci": "science", "natl": "national", "intl": "international", "int": "international", "wg": "working group", "childrens": "children", "epil": "epilepsy"}
BODY_WORDS = frozenset({*ORGANISATION.values(), *SHORT.values()} | set("working rare disease diseases health genetics epilepsy ataxia neurology children medical general national international research study clinical".split())) - {"working group"}
EMPTY = frozenset("the of and for in at on und fur der die das de la le et y a an s".split())
# Short forms of given names and the full names they stand for, the commonest first.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan alexander", "alex": "alexander alexandra", "andy": "andrew", "annie": "anne anna", "art": "arthur", "becky": "rebecca", "becca": "rebecca", "ben": "benjamin", "benny": "benjamin", "bert": "albert robert",
    "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "brad": "bradley", "cathy": "catherine katherine", "charlie": "charles charlotte", "chris": "christopher christine christian christina",
    "chuck": "charles", "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "don": "donald", "doug": "douglas", "drew": "andrew", "ed": "edward edwin", "eddie": "edward", "ellie": "eleanor", "fran": "frances francis",
    "frank": "francis franklin", "fred": "frederick alfred", "freddie": "frederick", "gabe": "gabriel", "gene": "eugene", "geoff": "geoffrey", "greg": "gregory", "hank": "henry", "harry": "henry harold", "jack": "john", "jake": "jacob", "jan": "janet janice", "jeff": "jeffrey",
    "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald jerome", "jess": "jessica", "jill": "gillian", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "johnny": "john", "jon": "jonathan", "josh": "joshua", "judy": "judith", "kate": "katherine catherine", "kathy": "katherine kathleen", "katie": "katherine",
    "ken": "kenneth", "kim": "kimberly", "larry": "lawrence", "len": "leonard", "leo": "leopold leonard", "lex": "alexander", "libby": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "lou": "louis louise", "maggie": "margaret", "mandy": "amanda", "marge": "margaret", "matt": "matthew", "max": "maximilian maxwell", "meg": "margaret", "mel": "melanie melissa",
    "mick": "michael", "mickey": "michael", "mike": "michael", "mitch": "mitchell", "molly": "mary", "nancy": "anne", "nat": "nathaniel natalie", "nate": "nathan nathaniel", "ned": "edward", "nick": "nicholas", "nicky": "nicholas nicole", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pete": "peter", "phil": "philip", "polly": "mary",
    "ray": "raymond", "rick": "richard", "rich": "richard", "rob": "robert", "robbie": "robert", "ron": "ronald", "rosie": "rosemary", "russ": "russell", "sally": "sarah", "sam": "samuel samantha", "sandy": "alexander sandra", "steph": "stephanie", "steve": "stephen steven", "stu": "stuart", "sue": "susan", "susie": "susan", "suzy": "susan", "tara": "tamara",
    "ted": "edward theodore", "terry": "terence theresa", "theo": "theodore", "tim": "timothy", "tina": "christina", "toby": "tobias", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "trish": "patricia", "val": "valerie", "vicky": "victoria", "vic": "victor victoria", "walt": "walter", "wendy": "gwendolyn", "will": "william", "willy": "william", "zach": "zachary", "andi": "andrea", "dee": "deborah",
}


def fold(text: str) -> str:
    """Lower case without marks on letters."""
    text = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


@dataclass
class Form:
    """What one spelling says. ``tokens`` are full words whose role is open."""

    kind: str = "person"
    surname: str = ""
    given: list[str] = field(default_factory=list)
    initials: list[str] = field(default_factory=list)
    short: str = ""  # an abbreviation ending in a full stop
    nick: str = ""
    tokens: list[str] = field(default_factory=list)


def _organisation(words: list[str]) -> list[str] | None:
    """Folded words of an organisation without empty ones; None for a person."""
    known = [ORGANISATION.get(w) for w in words]
    if not any(known) or len(words) < 3 and not any(k and w not in ("found", "cons", "reg", "lab", "coll", "comm", "soc", "team", "unit", "trust") for k, w in zip(known, words)):
        return None
    out: list[str] = []
    for w, k in zip(words, known):
        if w not in EMPTY:
            out += (k or SHORT.get(w) or w).split()
    return out


def read_name(spelling: str) -> Form:
    """The form of one spelling; a spelling without letters gives an empty form."""
    flat = fold(spelling.replace("’", "'"))
    words = [w for w in re.split(r"[^\w]+", flat.replace("'s", "").replace("&", " and ")) if w]
    org = _organisation(words)
    if org is not None:
        return Form(kind="organisation", tokens=org)
    f = Form()
    text = spelling
    for m in re.finditer(r"[(\"“”«]([^()\"“”»]+)[)\"“”»]", text):
        f.nick = f.nick or "".join(c for c in fold(m.group(1)) if c.isalpha())
    text = re.sub(r"[(\"“”«][^()\"“”»]*[)\"“”»]", " ", text)
    parts = [p.strip() for p in text.split(",")]
    parts = [p for i, p in enumerate(parts) if p and (i == 0 or not all(fold(w).replace(".", "") in DEGREES for w in p.split()))]
    if not parts:
        return f
    if len(parts) > 1:
        f.surname = "".join(c for c in fold(parts[0]) if c.isalpha())
        _given_words(f, " ".join(parts[1:]), all_caps=False)
        return f
    raw = re.sub(r"\.(?=\w)", ". ", parts[0]).split()
    while raw and fold(raw[0]).strip(".") in TITLES and len(raw) > 2:
        raw = raw[1:]
    while len(raw) > 2 and fold(raw[-1]).replace(".", "") in DEGREES and (raw[-1].isupper() or raw[-1][-1:].isupper()):
        raw = raw[:-1]
    shouting = all(w.isupper() for w in raw)
    particle = [i for i, w in enumerate(raw) if fold(w) in PARTICLES and i + 1 < len(raw)]
    if particle:
        i = particle[0]
        j = i
        while j + 1 < len(raw) and fold(raw[j]) in PARTICLES:
            j += 1
        f.surname = "".join(c for w in raw[i : j + 1] for c in fold(w) if c.isalpha())
        _given_words(f, " ".join(raw[:i] + raw[j + 1 :]), shouting)
        return f
    caps = [w for w in raw if w.isupper() and len(w.strip(".")) > 3]
    if len(caps) == 1 and not shouting:
        f.surname = "".join(c for c in fold(caps[0]) if c.isalpha())
        _given_words(f, " ".join(w for w in raw if w != caps[0]), False)
        return f
    _given_words(f, " ".join(raw), shouting)
    full = f.given
    if len(full) == 1 and (f.initials or f.short):
        f.surname, f.given = full[0], []
    else:
        f.tokens, f.given = full, []
    return f


def _given_words(f: Form, text: str, all_caps: bool) -> None:
    """Sort the words of a given name into full ones, initials and a short form."""
    for w in re.sub(r"\.(?=\w)", ". ", text).split():
        letters = "".join(c for c in fold(w) if c.isalpha())
        if not letters:
            continue
        if len(letters) == 1 or (len(letters) <= 3 and w.isupper() and not all_caps and not w.endswith(".")):
            f.initials += list(letters)
        elif w.endswith(".") and len(letters) >= 2:
            f.short = f.short or letters
        else:
            f.given.append(letters)
