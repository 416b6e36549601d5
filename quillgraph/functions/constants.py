"""Fixed values of the domain: word lists, lookup tables and weights that results depend on."""

# Words left out of retrieval tokens.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "because", "been", "between", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has",
    "have", "how", "i", "in", "into", "is", "it", "its", "may", "more", "most", "of", "on", "or", "our", "should", "than", "that", "the", "their", "them",
    "then", "there", "these", "this", "those", "to", "was", "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "without",
    "about", "patient", "patients", "child", "children", "caregiver", "caregivers", "disease", "disorder", "condition",
]

# Tokens too broad to say what a question is about.
BROAD_TOKENS = [
    "dravet", "syndrome", "disease", "disorder", "condition", "patient", "patients", "child", "children", "study", "evidence", "article", "paper",
    "research", "clinical", "preclinical", "model", "mouse", "mice", "rat", "zebrafish", "human", "seizure", "epilepsy", "epileptic", "severe",
    "early", "year", "life", "first", "prevent", "prevents", "preventing", "reduce", "reduces", "reduced", "treat", "treats", "treatment", "therapy",
]

# Question intents, what triggers them and what they look for.
INTENTS = {
    "differential": {
        "triggers": ["distinguish", "distinguishing", "differentiate", "differentiating", "difference", "differences", "differential", "versus", "vs", "compare", "comparison", "other"],
        "terms": ["diagnosis", "diagnostic", "differential", "phenotype", "phenotypic", "feature", "features", "clinical", "onset", "development", "developmental", "febrile", "fever", "genetic", "variant", "mutation", "electroclinical", "encephalopathy", "classification"],
    },
    "therapy_evidence": {
        "triggers": ["evidence", "prevent", "prevents", "preventing", "reduce", "reduces", "reduction", "protect", "protective", "efficacy", "effective", "treat", "treatment", "therapy"],
        "terms": ["efficacy", "effective", "protective", "protection", "reduce", "reduction", "seizure", "frequency", "survival", "therapy", "treatment", "rescue"],
    },
    "mechanism": {
        "triggers": ["mechanism", "why", "how", "pathway", "cause", "causes"],
        "terms": ["mechanism", "pathway", "expression", "function", "loss", "gain", "channel", "neuron", "interneuron"],
    },
}

# Words that make no search phrase by themselves, and words that make no anchor.
PHRASE_GENERIC = [
    "what", "which", "when", "where", "whether", "about", "that", "this", "there", "their", "with", "without", "from", "into", "within", "between",
    "evidence", "study", "studies", "article", "paper", "papers", "effect", "effects", "prevent", "prevents", "preventing", "reduce", "reduces", "reduced",
    "seizure", "seizures", "epilepsy", "epilepsies", "dravet", "syndrome", "patient", "patients", "mouse", "model", "models", "clinical", "severe",
]
ANCHOR_GENERIC = [
    "dravet", "syndrome", "seizure", "seizures", "epilepsy", "epileptic", "patient", "patients", "study", "studies", "evidence", "prevent", "prevents", "preventing",
    "reduce", "reduces", "reduced", "clinical", "model", "models", "mouse", "mice", "rat", "rats", "zebrafish", "severe", "first", "year", "life", "other", "article", "paper", "papers", "treatment",
]

# Labels too generic for a triple.
GENERIC_ENTITIES = ["study", "this study", "article", "paper", "authors", "researchers", "results", "method", "methods", "discussion", "introduction", "patient", "patients", "children", "subjects", "participants", "data", "analysis"]
GENERIC_PREDICATES = ["is", "are", "was", "were", "has", "have", "had", "shows", "show", "demonstrates", "demonstrated", "reports", "reported", "describes"]

# Predicate phrases and their relation.
PREDICATES = {
    "treated with": "hasTreatment", "is treated with": "hasTreatment", "can be treated with": "hasTreatment", "used to treat": "hasTreatment", "therapy for": "hasTreatment", "has treatment": "hasTreatment",
    "preferred medication": "hasPreferredMedication", "has preferred medication": "hasPreferredMedication",
    "associated with": "isAssociatedWith", "is associated with": "isAssociatedWith", "association with": "isAssociatedWith", "linked to": "isAssociatedWith", "related to": "isAssociatedWith",
    "causes": "causes", "leads to": "causes", "results in": "causes", "contributes to": "contributesTo", "increases": "increases", "increased": "increases", "decreases": "decreases", "decreased": "decreases",
    "reduces": "reduces", "reduced": "reduces", "improves": "improves", "improved": "improves", "worsens": "worsens", "worsened": "worsens", "prevents": "prevents", "prevented": "prevents",
    "has phenotype": "hasPhenotype", "presents with": "hasPhenotype", "characterized by": "hasPhenotype", "has symptom": "hasSymptom", "has comorbidity": "hasComorbidity", "has mutation": "hasVariant", "has variant": "hasVariant",
    "involves": "involves", "affects": "affects", "modulates": "modulates", "targets": "targets", "measured by": "isMeasuredBy", "assessed by": "isAssessedBy", "evaluated by": "isAssessedBy",
    "has outcome": "hasOutcome", "has adverse event": "hasAdverseEvent", "has side effect": "hasAdverseEvent",
}
# Patterns tried in this order where no phrase fits; the stems stand between word ends.
PREDICATE_STEMS = [
    (r"\b(associat|link|correlat|relat)\b", "isAssociatedWith"),
    (r"\b(reduc|decreas|lower)\b", "reduces"),
    (r"\b(increas|elevat|raise)\b", "increases"),
    (r"\b(improv)\b", "improves"),
    (r"\b(worsen|exacerbat)\b", "worsens"),
    (r"\b(caus|lead|result)\b", "causes"),
    (r"\b(variant|mutation)\b", "hasVariant"),
    (r"\b(phenotype|manifest|characteri[sz]ed|present)\b", "hasPhenotype"),
    (r"\b(comorbid|co-occurr|cooccur)\b", "hasComorbidity"),
    (r"\b(measur|assess|evaluat)\b", "isAssessedBy"),
]
TREATMENT_WORDS = (r"\b(treat|therapy|therapeutic|medication|drug)\b", r"\b(with|for|using|used)\b")

# Section titles, their weights and their rank for duplicates.
SECTIONS = {
    "introduction": "Introduction", "background": "Introduction", "intro": "Introduction", "overview": "Introduction",
    "methods": "Methods", "method": "Methods", "materials and methods": "Methods", "patients and methods": "Methods", "subjects and methods": "Methods", "experimental procedures": "Methods", "study design": "Methods",
    "results": "Results", "findings": "Results", "discussion": "Discussion", "conclusion": "Discussion", "conclusions": "Discussion", "discussion and conclusion": "Discussion", "discussion and conclusions": "Discussion",
}
SECTION_RANK = {"Results": 4, "Methods": 3, "Discussion": 2, "Introduction": 1}
SECTION_NEEDLES = [
    ("materials and methods", "materials and methods"), ("patients and methods", "patients and methods"), ("methods", "methods"), ("method", "methods"), ("results", "results"), ("result", "results"), ("discussion", "discussion"),
    ("conclusion", "conclusion"), ("background", "background"), ("introduction", "introduction"), ("case report", "case report"), ("case presentation", "case presentation"), ("supplementary", "supplementary"),
]
SECTION_WEIGHTS = {
    "title": 6.0, "abstract": 4.0, "methods": 4.5, "materials and methods": 4.5, "patients and methods": 4.5, "results": 4.5, "case report": 4.2, "case presentation": 4.2,
    "discussion": 2.2, "conclusion": 2.2, "supplementary": 1.0, "background": 1.0, "introduction": 0.75, "default": 1.5,
}
EVIDENCE_SECTIONS = ["methods", "materials and methods", "patients and methods", "results", "case report", "case presentation"]

# Limits of labels.
MAX_ENTITY_CHARS, MAX_PREDICATE_CHARS, MAX_ENTITY_WORDS, MAX_PREDICATE_WORDS = 120, 90, 12, 10
MAX_SECTION_CHARS = 18000

# How preprints are told.
PREPRINT_SOURCES = ["biorxiv", "bioarxiv", "bio archive", "medrxiv", "medarxiv", "med archive"]
PREPRINT_DOIS = ["10.1101/", "10.64898/"]

# Terms of the topic and of what a text says about it.
TOPIC_TERMS = ["dravet syndrome", "severe myoclonic epilepsy of infancy", "smei", "scn1a-related epileptic encephalopathy", "dravet"]
TOPIC_SHORT = [" ds ", " ds,", " ds.", " ds;", " ds:", "(ds)", "[ds]"]
TOPIC_PATIENTS = ["patients with dravet syndrome", "children with dravet syndrome", "dravet syndrome patients", "dravet cohort", "dravet group", "dravet mouse model", "dravet zebrafish model", "scn1a dravet", "in dravet syndrome", "with dravet syndrome"]
TOPIC_PASSING = ["such as dravet syndrome", "including dravet syndrome", "for example dravet syndrome", "for example, dravet syndrome", "e.g. dravet syndrome", "e.g., dravet syndrome", "other epilepsies such as dravet syndrome", "conditions such as dravet syndrome"]

# Keywords of each axis, type and organism, in order of precedence.
AXES = {
    "Seizures": ["seizure", "status epilepticus", "convulsion", "myoclonic", "tonic-clonic", "semiology", "febrile seizure", "epileptic spasm"],
    "Genetics": ["scn1a", "gene", "genetic", "genotype", "variant", "mutation", "allele", "pathogenic", "de novo"],
    "Development": ["development", "developmental", "cognitive", "intellectual", "language", "learning", "adaptive", "milestone", "neurodevelopment"],
    "Pharmacology": ["drug", "therapy", "treatment", "medication", "antiseizure", "anticonvulsant", "cannabidiol", "fenfluramine", "stiripentol", "valproate", "clobazam"],
    "Comorbidities": ["comorbidity", "sleep", "gait", "ataxia", "gastrointestinal", "autonomic", "infection", "pain", "orthopedic", "endocrine"],
    "Behavior": ["behavior", "behaviour", "autism", "attention", "adhd", "psychiatric", "anxiety", "mood", "aggression", "social"],
    "SUDEP": ["sudep", "sudden unexpected death", "mortality", "death", "fatal"],
    "Drug Responsiveness": ["response", "responsive", "resistance", "refractory", "efficacy", "effectiveness", "outcome", "retention", "adverse event", "tolerability"],
    "Electrophysiology": ["eeg", "electroencephal", "electrophysiolog", "spike", "wave", "recording", "channel", "patch clamp", "neuronal excitability"],
}
TYPES = {
    "Review": ["review", "narrative review"], "Systematic Review": ["systematic review"], "Meta-Analysis": ["meta-analysis", "metaanalysis"], "Case report": ["case report"], "Case series": ["case series"],
    "Editorial": ["editorial"], "Commentary": ["commentary", "perspective"], "Letter": ["letter to the editor", "letter"], "Opinion": ["opinion"], "Conference Abstract": ["conference abstract", "meeting abstract", "poster abstract"],
    "Original": ["methods", "results", "participants", "patients and methods", "we enrolled", "we analyzed", "we analysed", "study cohort", "retrospective", "prospective", "experiment", "mouse model", "clinical trial", "observational", "case-control", "cross-sectional"],
}
FIRST_TYPES = [
    ("Systematic Review", ["systematic review", "systematic literature review"]), ("Meta-Analysis", ["meta-analysis", "metaanalysis"]), ("Review", ["review", "narrative review"]), ("Case report", ["case report"]), ("Case series", ["case series"]), ("Editorial", ["editorial"]),
    ("Letter", ["letter to the editor", "letter"]), ("Commentary", ["commentary", "perspective"]), ("Opinion", ["opinion"]), ("Conference Abstract", ["conference abstract", "meeting abstract", "poster abstract"]), ("Original", ["clinical trial", "cohort", "case-control", "cross-sectional", "observational"]),
]
ORGANISMS = {
    "Zebrafish": ["zebrafish", "danio rerio", "larvae", "embryo", "embryos"],
    "Mouse": ["mouse", "mice", "murine", "mus musculus", "knock-in", "knockout", "scn1a+/−", "scn1a+/-"],
    "Rat": ["rat", "rats", "rattus"],
    "Drosophila": ["drosophila", "fruit fly"],
    "Primate": ["primate", "macaque", "monkey"],
    "Human": ["patient", "patients", "child", "children", "adult", "adults", "human", "humans", "cohort", "clinical", "retrospective", "prospective", "case report", "case series", "participant", "participants"],
}
ORGANISM_CONTEXT = {
    "Human": ["patients with", "children with", "adults with", "study cohort", "we enrolled", "we included", "medical records", "retrospective review", "prospective study", "case report", "case series", "participant", "participants"],
    "Mouse": ["mouse model", "mice were", "mice received", "murine model", "scn1a mice", "knock-in mouse", "knockout mouse", "mutant mice"],
    "Rat": ["rats were", "rat model", "rattus"],
    "Zebrafish": ["zebrafish model", "zebrafish larvae", "larvae were", "danio rerio"],
    "Drosophila": ["drosophila model", "flies were", "fruit fly model"],
    "Primate": ["macaque", "monkey model", "primate model"],
}
ORGANISM_PASSING = ["previous studies in", "prior studies in", "reported in mice", "reported in zebrafish", "reported in rats", "reported in patients", "animal models such as", "models such as"]
