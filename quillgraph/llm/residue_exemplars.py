"""Labelled exemplars of template residue, filler, error pages and script notices.

Fixed values, written by hand.  An exemplar is one sentence as a row of places; a place
lists the words that can stand there, parted by ``|``; one that ends in ``?`` may be
missing.  ``@thing``, ``@field`` and ``@neg`` are the word lists below; words in capitals are the
marks of ``residue.tokens`` (SLOT: an unfilled placeholder of any syntax).
"""

THING = "article|page|document|record|file|section|resource|full|text|reader|viewer|archive|service|site|website|server|store|abstract|figure|content|url|address|link|request|item|database|system|application|app|portal|image|video|map|form"
FIELD = "summary|results|title|subtitle|heading|conclusion|abstract|introduction|methods|background|figure|legend|discussion|section|paragraph|table|keywords|text|content|caption|copy|description|name|image|chapter|body"
NEGATION = "not|cannot|can't|couldn't|doesn't|don't|didn't|isn't|wasn't|aren't|won't|unable|failed|failure|never"
#: Words that may stand in any error message or notice and say nothing by themselves.
ANYWHERE = "sorry oops unfortunately please kindly reference NAME".split()

TEMPLATE = """
SLOT
@field|authors|author|journal|date|doi|email|to|from|subject? SLOT
dear|hello|hi|hey|welcome SLOT your? manuscript|order|request|submission|account|letter|appointment? thank|thanks? welcome? has|have|been|received|for|to|by? SLOT?
thank|thanks you? for? your? SLOT @field|order|interest?
the? main finding|result|aim is SLOT keywords? SLOT?
we studied|enrolled|treated|examined SLOT in patients|participants|mice? treated? with? SLOT?
in SLOT was|were given|administered|measured at? SLOT mg|ml? kg?
best|kind|regards|sincerely|signed yours? SLOT
this is a placeholder|dummy|sample|example|stub for|of|text? @field? do? not? publish?
do not publish|print|distribute
sample|dummy|placeholder|example|blind|mock @field for? the? @field?
replace it|this|me|them with your own? words|text|content|data|image?
replace|delete|remove|overwrite|edit this|the|me block|instruction|instructions|text|paragraph|line|section?
your @field|headline|logo|tagline|name|company|organisation|study here|goes add? a? short? description? of? your? study?
your @field|headline|logo|tagline|name|company here|goes
dummy|sample|placeholder @field to be overwritten|replaced|written|added|supplied|provided|completed|filled by? authors|author|editor?
to be overwritten|replaced|written|added|supplied|provided|completed|filled|determined|announced|confirmed|defined by? authors|author|editor|later|in? @field?
@field of? the? @field? goes|go|comes here @field?
content|text|copy|@field of? the? @field? to follow|come
@field will|to be added|written|supplied|available|follow soon|later|shortly
type|write|enter|put|insert|paste|add|fill the|a|your|some @field|name|comments in? this? box|field|here|below
insert|add|enter|type|put|paste|click|tap your|the|some|a main|first|second|key|own? @field|name|here|point|idea|quote|date|title|subtitle|heading|company here|below?
click|tap|double|press to|here add|edit|insert|enter|change title|text|notes|subtitle|picture|image|caption @field?
@field|content|page|site|website|more coming soon
coming soon
under construction @thing is? currently?
edit this|me block|template|page|section|in? admin|settings?
add|type|insert your|some @field
hier|an dieser? stelle steht|kommt|folgt|stehen später|noch der|ein|die text|inhalt|abschnitt|@field
platzhalter|mustertext|blindtext|beispieltext für? den? text|titel|abschnitt?
texte|titre|contenu|résumé|paragraphe à|a compléter|venir|remplir|insérer
texto|título|contenido|párrafo de ejemplo|relleno|muestra aquí?
heading|subheading|headline|caption|affiliation level? one|two|three?
bullet|item|column|row|option|step|section one|two|three|four|point?
author name|names
key|main message|messages|point|points
@field|author|company|first|last|job name|title|here
untitled|unnamed document|page|section|presentation?
patient|total|amount|phone|address|id|number|city|country|company|price|order|invoice|ref|reference|username|password|age|sex|time|location|signature SLOT
document|report|page|article|presentation title|name|heading
this is an? example|sample|demo|test page|post|document|text|paragraph|article|entry
replace this|the sentence|paragraph|text|line|block|section|heading with your|own|real? @field?
edit|delete|change|remove this|or|and edit|delete|remove|it? post|page|item|entry|draft|example
sample|example|demo text|content|post
click|tap|double to select|edit|start|begin the? text|typing|box|editing box?
lorem ipsum
dear|hello|hi|hey SLOT your results|order|request|account|appointment|manuscript|file|report|download|invoice is|are|has|been|have ready|received|confirmed|approved|available|processed|shipped|rejected
tbd|tba|tbc|todo|fixme|placeholder|untitled
lipsum|placeholder
n.n.n.|n.n. n.n.?
"""

FILLER = """
3*lorem|ipsum|dolor|amet|consectetur|adipiscing|elit|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|reprehenderit|voluptate|velit|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|proident|culpa|officia|deserunt|mollit|anim|laborum sit|sed|do|ut|et|enim|ad|minim|ex|ea|in|esse|eu|non|sunt|qui|id|est?
2*asdf|qwerty|asdfgh|qwertz|sdf|jkl|hjkl|zxcv|xcvb|uiop|aaa|bbb|ccc|xxx|yyy|zzz|xyz|abc|foo|bar|baz|qux|blah|bla|tbd|tba|tbc|todo|fixme|xx|test|testing|dummy|text|n.n.
the quick brown fox jumps over the? lazy dog
"""

ERROR = """
CODE @neg found the? page|file|url?
@neg found the? page|file|url|CODE|error
CODE gone|forbidden|unauthorized|unavailable|timeout|conflict|teapot|acceptable|error|internal|payment|proxy|http|status|page not|allowed|request|required|service|server|error|out|authentication|found|a|i?
CODE bad|invalid|method|expectation request|allowed|failed not?
forbidden|unauthorized CODE|access|you|page|request?
gone CODE
bad|invalid request|gateway CODE?
too many requests|attempts|redirects|connections from? your|this? address|network|ip|CODE|account?
internal server|system|error|fault|failure CODE|error|occurred|fault|has?
internal fault|failure|exception CODE|TROUBLE?
service|server|site temporarily? unavailable|busy|overloaded CODE|later?
gateway|request|connection|operation|query|session|server|read timeout|timed|time|lost|refused|reset|closed|aborted|interrupted|failed out? CODE|by|peer|host|after?
the|no|a? connection|link? to|with? the? database|server|host|network|session|backend could|can|cannot not? be? established|reached|resolved|opened|contacted|verified|made connection?
@neg could|can|to? connect|reach|resolve|contact|communicate to|with? the? database|server|host|network|service|@thing
error establishing|opening|loading|reading|processing|fetching|retrieving|parsing a? database|connection|@thing
requested|angeforderte @thing could|was|cannot|can not|be|longer|found|located|retrieved|exist|available on? this? server|system?
@thing could|can|did|was|were|does? @neg be|been found|located|loaded|displayed|opened|retrieved|shown|rendered|reached|completed|processed|exist on? server|system|anymore?
@thing you were? looking|requested|for|trying|tried|want|asked cannot|could|not|found|moved|removed|exist|longer|deleted|available|renamed
@thing has|may|been|might|have been|was moved|removed|deleted|renamed|withdrawn|expired
server|system|service could|can? @neg complete|process|handle|fulfil|fulfill|answer|serve your? request|query for? @thing?
upstream|remote|origin host|server did|does|not answer|respond|reply in? time? while? @thing? was? fetched|loading?
you asked|requested|queried for? the? @thing too often
you|are @thing @neg available to you
you not|have|do|are allowed|permitted|authorized|authorised|permission|rights|entitled to? view|see|access|open|read|use? @thing?
access|permission|entry|zugriff|acceso|request|connection denied|forbidden|verweigert|denegado|refused|blocked|restricted contact|to|by? your? administrator|admin|server|firewall|support|CODE?
we|you could|can|had? @neg|trouble to|be? find|load|open|opening|fetch|show|display|retrieve|get|access|reach|trouble|process|complete|locate|save @thing
we|reader|viewer|server|browser|system|app|application|safari|chrome|firefox could|can|had? @neg|trouble to|be? find|load|open|opening|fetch|show|display|retrieve|reach|trouble|process|locate|render @thing
contact the|your|our help|support|administrator|admin|webmaster|team desk|team|us? if? this? goes|persists|problem|continues|happens|again|error? on?
try|retry|reload|refresh|check again|later|page|url|address|in|minutes|minute|browser|spelling|connection|once? later|few|moments|address|more?
retry in|after? minutes|seconds|hours|moment?
please try|wait|check|retry again|later|moment|connection|url|while|few
go|return|back|take to|back|me home|homepage|start|previous page|screen?
reload|refresh the|this page|window|browser|tab
we are|re working|fixing|investigating|looking|upgrading|updating|improving on|into? it|issue|problem|systems|site|this|our
something|anything went|gone wrong try? again?
an? unexpected|unknown|unhandled|internal|application|fatal|critical|serious|error error|exception|problem|occurred|happened|condition has|occurred|been|while? @thing?
we'll|we|will be? back|available|online shortly|soon|later|minutes|moment upgrading|updating|improving|maintaining? systems|site|service?
we|@thing are|is currently? undergoing|performing|doing|conducting|having scheduled|planned|routine|some? maintenance|upgrade|upgrades
your session|login|token|link|cookie|subscription|connection|password has|is|have? expired|timed|invalid|ended|lapsed out?
you have|been|are|were signed|logged|locked|timed|blocked|banned|redirected out|off|by|from?
please? sign|log in|again|on to? continue|view|access|read? again|account|@thing?
verify|confirm|prove|check|verifying that|if? you are|not? human|robot|bot by|completing|action|below|checkbox|press|hold|click?
complete|solve|pass|fill|enter the captcha|challenge|check|puzzle|verification|security below|to|proceed|continue|go|on?
unusual|suspicious|automated|abnormal traffic|activity|requests|queries from|detected? your|this? network|address|computer|account|ip?
@thing is blocked|restricted|unavailable|prohibited|forbidden at|by|in|from? your institution|country|region|administrator|network
@thing|we is|are|be|currently|temporarily down|offline|unavailable|closed|overloaded|busy|inaccessible for|due|to? maintenance|upgrade|update|load|while?
@thing is|are being|currently|undergoing updated|upgraded|maintenance|moved|migrated|repaired
scheduled|planned|routine|emergency maintenance|downtime|outage|upgrade in? progress|window?
back at|again|in|by shortly|soon?
online|available again|shortly|soon|back at|in|by? expected? duration|shortly|soon?
expected|estimated duration|time|downtime min|minutes|hours?
wait|waiting seconds|minutes|moment|while
@thing is|are over|beyond|at|exceeded capacity|quota|limit|bandwidth
@thing temporarily|currently|momentarily|is unavailable|offline|inaccessible|down
valid|no reply|answer|response|result for|from? @thing?
no such @thing|file|directory|element|key|table|host NAME?
CODE error? @thing not|unavailable|found|missing|denied|no|such
NAME|status|code|message|data|path|error|errors|detail|reason|trace|timestamp|type|success|false|null|requestid|exception CODE|error|@thing unavailable|not|found|missing|failed|null|denied|error|false|NAME path|data|full|message?
error code|message|status|CODE message|no|such|requestid|@thing|CODE
traceback|stacktrace|stack most|trace|dump recent? call|follows? last?
file? FILE line in?
TROUBLE index|connection|read|x|key|object|name|value|unexpected|no|null|cannot|can't|undefined|timed|invalid|such|could|division|maximum|not|broken|literal|base|recursion|depth|int|string|float|convert|argument|arguments|unsupported|operand|memory|space|permission|expected|got|missing|positional|keyword|takes|given|list|dict|tuple|indices|must|callable|iterable|unhashable|decode|encode|codec|byte|bytes|position|attribute|module|named|socket|pipe|file|directory|exists|failed|while|reading|property|properties? refused|reset|out|range|undefined|end|input|element|after|defined|reference|token|type|property|exceeded|zero|found|subscriptable|pointer|closed|denied|with|for|by|peer|be|has|function|line|variable? FILE|FRAME|NAME|of|is|in|to|on|a?
uncaught|unhandled TROUBLE|exception|error|promise x|is|FILE|undefined|rejection?
caused by|from? TROUBLE|FRAME|FILE
FRAME FILE?
in? FILE on|at|in|line line?
goroutine running|main|created
panic|fatal|abort|aborted|exception read|connection|unexpected|index|runtime|kernel|error|assertion|in timed|refused|end|out|range|input|error|memory|failed|thread|main after|of|invalid|address?
exit|return|process|program status|code|finished|terminated|exited with|code|signal?
sql|mysql|postgresql|oracle|sqlite|database|query error|syntax|exception|state|failed relation|table|column|near|does|not|exist|syntax|server|version|check?
relation|table|column|function|database does|not exist|found near?
warning|notice|fatal|parse|strict|deprecated error|cannot|modify|undefined|call|syntax|unexpected|division header|information|function|variable|index|offset|sent|line|end|FRAME FILE|in|on|line?
fatal error|exception|call|uncaught call|undefined|allowed|memory|maximum|FRAME|exhausted|time function|FRAME|FILE|size|on|exceeded|execution?
segmentation|bus|memory|protection|access fault|violation|error|exhausted core? dumped?
core dumped
out of memory|space|resources
stack trace|overflow|dump
@thing could|can? @neg be? reached|found|opened|loaded|displayed|located|resolved|retrieved
server|server's|host|domain ip|dns address|name|lookup could|be? @neg found|resolved?
dns probe|error|lookup|server|name finished|failed|nxdomain|resolution|not? started|bad|config|internet|no?
you do|don't not|have? have|got access|permission|rights|permissions|privileges to? this|the? view|read|open|see? @thing? account|user?
@thing is no longer available|here|online|supported|exists
@thing is not? available|accessible in|for|to? your|this? country|region|location|account|institution|you
@thing has been denied|blocked|suspended|disabled|removed|deleted|moved
access to this|the? @thing|account denied|blocked|restricted|forbidden|disallowed has? been?
went wrong on|at? our|this? end|side
@thing|program has|have encountered|experienced|hit a|an? problem|error|issue|exception needs? to|and? close|restart|closed?
specified|requested|given key|bucket|@thing does|not? exist|found
nosuchkey|accessdenied|notfound|badrequest|internalerror|nosuchbucket|invalidrequest
you? have? an? error in? your sql|query|command syntax near|check|manual|at?
table|view|column|relation or|and? view|table|column? does not? exist|found
ora|sqlstate|sqlcode|errno|hresult|err table|connection|view|refused|timeout|reset|peer|no|such|file|not|exist|error|name|resolved|disconnected|found
TROUBLE no|cannot|failed module|import|file|attribute|key|name|such named|find|name?
connection reset|refused|closed|aborted|timed by|out? peer|host|server?
@thing you are? looking|requested|for|trying to|reach|open? has|may|been|might|have? moved|removed|deleted|renamed|exist|found
you will|are being|be? redirected|forwarded|transferred automatically? in|to|within? seconds|shortly|soon|moment|@thing
@thing|pdf could|can|be? @neg loaded|opened|displayed|completed|shown|rendered
error|err connection|name|timed|network|internet|ssl|cert|too|address refused|reset|closed|out|disconnected|resolved|invalid|redirects|unreachable not?
connection was|has been? interrupted|reset|dropped|lost|closed|refused|timed|terminated out? your|the?
server|host|peer unexpectedly|abruptly? dropped|closed|reset|terminated the? connection
proxy|server is? refusing|rejecting|rejected connections|connection|requests
upstream connect|connection|prematurely|timed|request error|closed|out|timeout disconnect|reset|before|headers|while|reading|response?
request unsuccessful|failed|blocked|rejected|denied incident|id|has|been|by|security|system|firewall?
apologize|apologise|sorry for the? inconvenience|disruption|delay
something|anything broke|broken|failed|happened on|at? our|this? side|end|please|refresh|page?
NAME|mysqli|connect|pdo|mysql access|connection denied|refused|failed for|user|root|localhost|using|password?
no such file|directory|host|key|table|column|element or? directory? enoent?
exception|error in? thread|task|worker main|NAME|TROUBLE? heap|space|java|TROUBLE?
outofmemoryerror|heap space|java|limit?
you|must|need|have|please be logged|signed in|on to|before? view|see|access|read|continue|@thing?
you|must|please login|log|sign|register to|in? view|see|access|read|continue|download? @thing?
authentication|login|password|subscription|registration|authorization|account required|failed|needed|necessary to|view|this|@thing?
access through|via|provided|requires your? institution|subscription|library|login required|to|view|this|content|is?
your account|access|profile|request has|is|was been? locked|suspended|disabled|blocked|deactivated|closed|rejected
preparing|generating|building|rendering your|the? @thing this|may|take|a|moment?
cette|la? page|article n'existe|existe pas|plus
page|objet non trouvé|trouvée
host|server|domain|resource|object|item|record|user|account|key not found
network|connection|server|ssl|proxy|database|script|application|internal|runtime|system|unknown|fatal error|failure occurred|try|again|please|check|your|connection|later|code|CODE?
this|the? @thing|access is|restricted|limited|reserved|available? to|for? subscribers|members|customers|subscription|registered|users|only only|users|of|the|journal|institution?
server|mysql|session|connection has? gone|went away
this|the @thing @neg working|responding|loading|available right? now?
javascript|js|scripts|scripting|cookies required|needed|necessary|mandatory to|for? view|see|use|read|run|display|load|access|this? @thing?
@thing|browser|session|connection|request has|was|is timed|expired|closed|cancelled|canceled|aborted|terminated out?
maximum|recursion|execution|memory|stack limit|depth|time|size|usage|overflow exceeded|reached
der|server|dienst|die|seite ist|wird|wurde zurzeit|gerade|derzeit|momentan|vorübergehend in|nicht wartung|erreichbar|überlastet|gewartet|verfügbar|ausgefallen
versuchen|bitte sie|es später|nochmals|morgen erneut|wieder|noch|einmal
seite|artikel|dokument|datei|angeforderte|inhalt nicht|konnte werden? gefunden|abrufbar|verfügbar|vorhanden|existiert mehr?
angeforderte artikel|seite|dokument|datei ist|wurde|konnte nicht mehr|gefunden abrufbar|verfügbar|vorhanden|werden?
zugriff|zugang verweigert|gesperrt|untersagt
interner|server serverfehler|fehler
erreur CODE|interne|serveur|de accès|page|du|réseau|connexion? refusé|absente|introuvable|serveur?
accès refusé|interdit|ou? page? absente?
service|site|serveur est? momentanément|temporairement|actuellement indisponible|interrompu|inaccessible|maintenance
merci|veuillez de? réessayer|patienter|recharger plus|la? tard|page?
page|article|document|ressource introuvable|absente|trouvée|existe|supprimée demandée|est|a|été|que|vous|recherchez?
error interno|de del|servidor|sistema servidor|sistema|conexión
inténtelo|intente|vuelva|inténtalo de|a nuevo|intentarlo|más tarde
no se ha|pudo|encontrado|encontró|encontrar el|la documento|página|archivo|artículo
página|documento|recurso|servicio no encontrada|encontrado|disponible|existe
vuelva|volver|regresar al|a inicio|página|la principal?
acceso|permiso denegado|prohibido
страница|документ|статья не найдена|найден|существует|найдено ошибка?
внутренняя|ошибка ошибка|сервера сервера|CODE?
доступ запрещён|запрещен|закрыт|ограничен
повторите|попробуйте попытку|ещё|снова позже|раз
сервис|сайт|сервер временно недоступен|закрыт|отключён
4*ペー|ージ|ジが|が見|見つ|つか|かり|りま|ませ|せん|んで|でし|した
4*お探|探し|しの|のペ|ペー|ージ|ジは|は見|見つ|つか|かり|りま|ませ|せん|んで|でし|した|存在|ござ|ざい
4*サー|ーバ|バー|ーエ|エラ|ラー|ーが|が発|発生|生し|しま|まし|した
4*しば|ばら|らく|くし|して|てか|から|らも|もう|う一|一度|度お|お試|試し|しく|くだ|ださ|さい
4*アク|クセ|セス|スが|が拒|拒否|否さ|され|れま|まし|した
3*页面|面不|不存|存在|面未|未找|找到|您访|访问|问的|的页|无法|法找|到页|找不|不到
3*服务|务器|器内|内部|部错|错误|请稍|稍后|后再|再试|后重|重试|务暂|暂时|时不|不可|可用|维护|护中
2*访问|问被|被拒|拒绝|问受|受限|没有|有权|权限
الصفحة|المقال غير|لم موجودة|موجود|متوفرة خطأ?
الخدمة|الخادم|الموقع غير متاحة|متاح|متوفرة مؤقتا|حاليا
η|σελίδα|άρθρο δεν|σελίδα βρέθηκε|υπάρχει σφάλμα?
σφάλμα διακομιστή|συστήματος|δικτύου
δοκιμάστε ξανά|πάλι αργότερα
"""

SCRIPT = """
you|must|need|have|please|kindly|should enable|activate|allow|turn|switch|permit|accept|use javascript|js|scripts|scripting|script|cookies client? side? active? on? in|for|on? browser|site|settings|device|before|so|page|app? continue|run|view|reload|load|figures|read|go|this|that|can|app|text|full|@thing?
to|go|continue|view|read|use|order enable|activate|allow|turn|switch|permit|accept|need|needs|must javascript|js|scripts|scripting|script|cookies in|for|on? browser|site|settings|device? figures|load|view|read|@thing?
enable|activate|allow|turn|switch|permit|accept javascript|js|scripts|scripting|script|cookies client? side? active? on? in|for|on? browser|site|settings|device? and|to|so|that|before? reload|view|load|figures|continue|@thing?
javascript|js|scripts|scripting|script|cookies is|are|appears|seems|been|must|should|have|has? disabled|turned|switched|blocked|supported|off|enabled|deactivated|unavailable|inactive client? side? active? browser|site|device|settings|off|not|on|for|in? so|nothing|can|be|displayed|cannot|shown|text|unfortunately? parts|page|work?
it? looks|seems|appears like|that? javascript|js|scripts|scripting|script|cookies is|are? disabled|turned|switched|blocked|off|supported|not client? side? active? browser|site|device|settings|on|in|for? so|nothing|can|be|shown|displayed|text|cannot?
parts|some|features|much of? page|site|app|functions @neg work|display|function|load properly?
our|this|the? page|site|application|archive|viewer|reader|app|website|content|feature|text|map requires|needs|relies|depends|uses|require on? javascript|js|scripts|scripting|script|cookies on|for|in? client? side? active? browser|site|device|settings? use|another|change|properly|work|function?
our|this|the? page|site|application|archive|viewer|reader|app|website @neg work|function|load|display|run|open without|unless javascript|js|scripts|scripting|script|cookies client? side? active? enabled? in|on|for? browser|site|device|settings?
your? browser|device does? @neg support|have|allow|run javascript|js|scripts|scripting|script|cookies
@thing|works|work work|works|runs|viewed best|only|properly|correctly with javascript|js|scripts|scripting|script|cookies enabled|on?
full|all|best functionality|features|experience of? this? @thing? necessary|need|requires|please|must? to? enable|activate|turn|on? javascript|js|scripts|scripting|script|cookies
@thing does|will? @neg work|function|display|load|run properly|correctly|right? without|unless javascript|js|scripts|scripting|script|cookies enabled?
without|with? javascript|js|scripts|scripting|script|cookies enabled|disabled|off|on|not|cannot page|site|application|archive|viewer|reader|app|website|work|function|displayed|content|see|view
change|check|adjust your settings|browser try|again|reload?
use|try another|different|modern|newer|upgrade|update|supported browser
upgrade|update your browser|version
browser|version is|not|no|longer supported|outdated|old|compatible
checking|verifying your? browser|connection before|if|is? you|secure|accessing get? @thing?
this|process may|can|should take a? moment|while|seconds not? block? scripts?
loading|opening|preparing|fetching|starting|initializing the|your|please? @thing|wait|data if? nothing? happens? allow? javascript|js|scripts?
loading|loading... please? wait|moment|data|content|page
if nothing happens|appears|loads allow|enable|click|reload javascript|js|scripts|scripting|here|cookies|page
redirecting|forwarding|sending|redirected you|to|automatically @thing
you may|might|need have|need to permit|allow|enable javascript|js|scripts|scripting|cookies
please wait|stand while|moment|by|few we|you? prepare|redirect|load|check|verify|are|redirected? @thing?
noscript|javascript|js required|disabled|needed|off|inactive
bitte aktivieren|erlauben|gestatten|schalten|zulassen|lassen sie javascript|skripte|cookies im|in? browser|ihrem? um|damit? abbildungen|volltext|seite|inhalt|sehen|lesen|zu|die|den|diese|fortzufahren?
diese|die|unsere seite|anwendung|website benötigt|braucht|erfordert|funktioniert|verwendet javascript|skripte|cookies nur? mit|ohne?
javascript|cookies ist|sind deaktiviert|abgeschaltet|ausgeschaltet|gesperrt browser?
veuillez|merci|vous|pour activer|autoriser|permettre|accepter|de|devez|il|faut javascript|scripts|cookies dans|de|sur? navigateur|votre? pour|afin? continuer|afficher|lire|voir|article|page|cette|contenu|texte|figures?
cette|ce|notre page|site|application nécessite|requiert|utilise|exige|fonctionne javascript|scripts|cookies
javascript|scripts|cookies est|sont désactivé|désactivés|bloqué navigateur?
active|habilite|permita|active|activar|habilitar|debe javascript|scripts|cookies en|su|el? navegador|para? continuar|ver|leer|contenido|artículo|página|texto|figuras?
esta|este página|sitio|aplicación requiere|necesita|usa javascript|scripts|cookies
4*javascript|このペ|この|のペ|ペー|ージ|ジを|を表|表示|示す|する|るに|には|ブラ|ラウ|ウザ|ザの|の|javascript|を有|有効|効に|オン|ンに|にし|して|てく|くだ|ださ|さい|本文|文を|を読|読む|むに|をオ
5*请启|启用|请在|在浏|浏览|览器|器中|中开|开启|打开|以查|查看|看此|此页|页面|javascript|后继|继续|续阅|阅读|读全|全文|您的|的浏|器不|不支|支持|需要
включите|разрешите|активируйте|необходим|требуется|нужен|нужно javascript|скрипты|сценарии|куки браузере|просмотра|продолжить|страницы|чтобы|пожалуйста|для|сайта|работы|в|браузера|чтения
يرجى|الرجاء|يجب|تفعيل|تمكين javascript|جافا|سكريبت تفعيل|المتصفح|للمتابعة|في|لعرض|الصفحة|تمكين
ενεργοποιήστε|επιτρέψτε|απαιτείται javascript|cookies πρόγραμμα|περιήγησης|στο|τη|την|για|συνεχίσετε|σελίδα|το
"""

# Lines around content; a window that one of these holds whole is no residue.
PLAIN = [
    "Home | Browse | About | Contact", "Skip to main content", "Back to search results", "Help and support", "Copyright notice. All rights reserved.", "Contact us", "About this site", "Search", "Log in", "Sign in",
    "Share this article", "Download PDF", "Cookie settings", "Privacy policy", "Terms of use", "Page not for sale", "Full text", "Abstract", "Title", "Author", "Summary", "Background", "Home page", "Site map", "Figure", "Results", "Methods", "Keywords", "References",
    "Author name", "Key message", "Key points", "Return to text", "Section title", "Table name", "Please wait",
]

#: (kind, exemplar) of every line above.
EXEMPLARS = [(kind, line) for kind, lines in (("template", TEMPLATE), ("filler", FILLER), ("error", ERROR), ("script", SCRIPT)) for line in lines.strip().split("\n")]

#: Everyday words of content; an exemplar is looked up by other places where it has them.
EVERYDAY = frozenset(
    """use used using open found find given shown show see work works change data response status problem form repeat expected sample video added written treated without unless text page
    main ended example contact home minutes please key point step value number line time day group image figure results title summary section table record file image item order complete
    message result answer code system available page site check read view load table map name error not""".split()
)

#: Function words; they never retrieve an exemplar and weigh little in its places.
FUNCTION_WORDS = frozenset(
    """the a an of to in on at for and or so is are was were be been being it its this that these those with by from as not no do does did will would can could cannot may might must should
    have has had you your we our us i me my he she they them their there here if then than but out up off over under again more most any some such only own same too very
    can't couldn't doesn't don't didn't isn't wasn't aren't won't hasn't haven't we're we'll you're you'll it's i'm they're let's
    der die das den dem des ein eine ist sind zu im in und oder sie es um mit nicht wird wurde le la les un une des de du et est sont pour dans ce cette votre ou plus sur el los las su en y o
    para del al lo que con por se ha no esta este в на и с не для η το τη την στο δεν في لم want go back one two three four after before near when while""".split()
)
