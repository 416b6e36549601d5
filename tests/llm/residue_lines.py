"""Labelled lines, split by family: exemplars and threshold were set with DEV and DEV_2 to
DEV_4 (held out at first: recall 39 of 58, 41 of 64 and 47 of 59 then), HELD_OUT was written after that and only scored.

Residue lines are worded as public software words them; plain lines write about such
things, or use their words.
"""

DEV = {
    "database down": ["The database connection could not be established.", "Error establishing a database connection", "Unable to connect to the database server."],
    "mail merge": ["Dear #FIRSTNAME#, thanks for #REASON#", "Hi {{first_name}}, thank you for your order {{order_id}}.", "Best regards, [Your Name]"],
    "captcha": ["Please complete the CAPTCHA to proceed.", "Verify you are human by completing the action below.", "Confirm that you are not a robot."],
    "core dump": ["Internal fault: segmentation violation (core dumped)", "Segmentation fault (core dumped)"],
    "upgrade": ["We'll be back shortly, upgrading our systems.", "We are currently undergoing scheduled maintenance.", "The site is down for maintenance."],
    "http": ["404 Not Found", "HTTP Error 503. The service is unavailable.", "403 Forbidden - you don't have permission to access this resource.", "502 Bad Gateway nginx", "Error 500: Internal Server Error"],
    "placeholder": ["[Insert abstract here]", "Your text goes here.", "Click to add title", "This is a placeholder for the abstract.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit."],
    "noscript": ["Please enable JavaScript to view this page.", "JavaScript is disabled in your browser.", "This site requires JavaScript to function properly.", "You need to enable JavaScript to run this app."],
    "trace": ["Traceback (most recent call last):", "java.lang.NullPointerException at com.example.Main.run(Main.java:17)", "TypeError: undefined is not a function", "Uncaught ReferenceError: x is not defined"],
}
DEV_PLAIN = [
    "The summary of the section is available in the archive.",
    "Error bars show the standard error of the mean; access to the full text was not required.",
    "Patients were asked to enter the text here and reload the page if the viewer failed.",
    "The internal server error of day 11 cost 20 minutes of telemetry; the other 265 h were complete.",
    "Please try again later was the answer given to 14 of 693 families who asked for an appointment.",
    "The reader app needed JavaScript on 47% of the tablets, and 24 families switched it on by themselves.",
    "Section 2 of the consent form (\"your name here\") was signed by 274 parents.",
    "Children who typed asdf or test in the answer box (4 of 310) were asked again.",
    "In the script {{n_patients}} and ${{dose}} are replaced at run time by the values of table 6, as described in the methods.",
    "We could not find a difference between the two groups.",
    "The page numbers refer to the printed edition.",
    "Access to care was denied in 14 of 200 cases.",
    "The line",
    "Results and discussion",
    "Title of the trial: dose finding in infants",
    "The connection between sleep and seizures could not be established.",
    "Text messages were sent to all parents, who were asked to reply within two days.",
    "Service was unavailable in rural areas, which was the reason for most missed visits.",
]

DEV_2 = {
    "dns": ["This site can't be reached.", "DNS_PROBE_FINISHED_NXDOMAIN", "The server's IP address could not be found."],
    "paywall": ["You do not have access to this article.", "Sign in to view the full text.", "Please log in to continue reading."],
    "rate limit": ["You have exceeded the request limit. Please wait a few minutes and try again.", "Too many attempts from your IP address."],
    "removed": ["The page you are looking for has been moved or deleted.", "This document is no longer available.", "The requested resource was not found on the server."],
    "cdn": ["Checking if the site connection is secure", "Access to this page has been denied.", "Sorry, you have been blocked.", "Attention Required! | Please enable cookies."],
    "app crash": ["Oops! Something went wrong on our end.", "An unexpected error has occurred.", "The application has encountered a problem and needs to close.", "Fatal error: Allowed memory size of 134217728 bytes exhausted"],
    "xml": ["<Error><Code>NoSuchKey</Code><Message>The specified key does not exist.</Message></Error>", "{\"status\": 404, \"message\": \"Resource not found\"}"],
    "sql": ["ERROR 1064 (42000): You have an error in your SQL syntax", "ORA-00942: table or view does not exist", "SQLSTATE[HY000] [2002] Connection refused"],
    "python": ["ModuleNotFoundError: No module named 'requests'", "File \"/srv/app/main.py\", line 33, in handler", "ConnectionResetError: [Errno 104] Connection reset by peer"],
    "word": ["[Type the document title]", "Click or tap here to enter text.", "Add your main point here", "Enter your caption here"],
    "cms": ["Insert text here", "Description coming soon", "Image caption goes here", "Sample paragraph. Replace this text with your own.", "Content to be added later."],
    "templating": ["${article.title} by ${article.author}", "{% include 'header.html' %}", "Hello %FIRST_NAME%, your appointment is on %DATE%.", "<%= user.name %>"],
    "lorem variants": ["Sed ut lorem ipsum dolor sit amet magna aliqua", "Duis aute irure dolor in reprehenderit in voluptate velit", "asdf asdf qwerty"],
    "noscript variants": ["For full functionality of this site it is necessary to enable JavaScript.", "Your browser does not support JavaScript!", "This app works best with JavaScript enabled.", "We're sorry but this website doesn't work properly without JavaScript enabled. Please enable it to continue."],
    "waiting": ["Loading, please wait...", "Redirecting to the article...", "You will be redirected in 5 seconds."],
    "session": ["Your session has timed out. Please log in again.", "Invalid token. Please sign in again."],
    "other languages": ["Diese Seite konnte nicht gefunden werden.", "Bitte aktivieren Sie JavaScript, um fortzufahren.", "La page demandée est introuvable.", "Esta página requiere JavaScript.", "Страница не найдена", "请启用JavaScript后继续"],
}
DEV_2_PLAIN = [
    "The error rate of the classifier fell from 12% to 4%.",
    "Participants could sign in to the study portal and complete the questionnaire at home.",
    "Not all patients were available for follow-up.",
    "The service was rated as good by 85% of the carers.",
    "A request for the file was sent to the hospital archive.",
    "In this section we describe the methods used to load the data.",
    "The server room of the sleep laboratory was moved in 2019.",
    "Time out of bed was recorded by actigraphy.",
    "Forbidden foods were listed in the leaflet.",
    "The full text of 44 articles was read by two authors.",
    "Missing values were replaced by the mean of the group.",
    "Connection strength between regions was lower in patients.",
    "Sample size was determined by simulation; see the appendix.",
    "Your doctor will tell you when to take the next dose.",
    "Do not use this medicine if you are allergic to it.",
    "Please contact your doctor if symptoms persist.",
    "The application of the ointment was repeated twice a day.",
    "Scripts for the analysis are written in R and can be requested from the authors.",
    "The browser history of adolescents was not analysed.",
    "We thank all families for their time.",
    "Access to genetic testing is limited in many countries.",
    "Figure 2 shows the loading of each item on the two factors.",
    "The original protocol could not be followed because of the pandemic.",
    "No reply was received from 12 of the 80 centres.",
    "It looks like the drug is well tolerated.",
    "The placeholder for the missing allele was coded as zero.",
    "One author typed \"lorem ipsum\" to test the form, which was removed before analysis.",
    "Der Patient konnte die Seite des Formulars nicht lesen.",
    "Les données de la page 4 sont incomplètes.",
    "Back pain was reported by 14 patients.",
]

DEV_3 = {
    "browser errors": ["ERR_CONNECTION_REFUSED", "Your connection was interrupted", "Safari can't open the page because the server unexpectedly dropped the connection.", "The connection has timed out"],
    "publisher": ["Sorry, the page you requested was not found.", "This article is not available in your region.", "Access through your institution is required to view this content.", "The PDF could not be loaded."],
    "proxy": ["The proxy server is refusing connections.", "504 Gateway Time-out", "upstream connect error or disconnect/reset before headers"],
    "waf": ["Your request has been blocked by the security system.", "Request unsuccessful. Incapsula incident ID: 443000270", "Our systems have detected unusual traffic from your computer network."],
    "apology": ["Oh no! An error occurred while loading the page.", "We apologize for the inconvenience, the service is temporarily down.", "Something broke on our side, please refresh the page."],
    "php": ["Warning: mysqli_connect(): Access denied for user 'root'@'localhost'", "Notice: Undefined index: id in /var/www/index.php on line 12", "Parse error: syntax error, unexpected end of file in page.php on line 3"],
    "node": ["Error: ENOENT: no such file or directory", "UnhandledPromiseRejectionWarning: TypeError: Cannot read property 'x' of undefined", "at Object.<anonymous> (server.js:10:5)"],
    "java": ["Exception in thread \"main\" java.lang.OutOfMemoryError: Java heap space", "Caused by: java.sql.SQLException: Connection timed out"],
    "json": ["{\"error\": \"not_found\", \"code\": 404}", "{\"message\": \"Internal server error\"}"],
    "documents": ["[Document title]", "Type your text here", "Replace this sentence with your abstract.", "Heading 1", "Add a subtitle here"],
    "themes": ["This is an example page.", "Edit or delete this post.", "Coming soon!", "Sample text. Click to select the text box."],
    "fields": ["Dear {{ recipient }},", "Yours sincerely, {{sender_name}}", "Date: [[DATE]]", "Patient: %PATIENT_NAME%", "Total: ${amount}"],
    "filler": ["Excepteur sint occaecat cupidatat non proident", "Lorem ipsum", "blah blah blah", "TODO TODO"],
    "script notices": ["JavaScript must be enabled in order for you to use this site.", "Please turn on JavaScript in your browser and refresh the page.", "It appears that your browser has scripts disabled.", "Enable JavaScript and cookies to continue"],
    "cookies": ["Cookies must be enabled in your browser to use this site.", "Please enable cookies and reload the page."],
    "loading": ["Loading content...", "Please wait while we verify your browser.", "Preparing your document, this may take a moment."],
    "auth": ["You must be logged in to view this page.", "401 Unauthorized", "Your account has been locked.", "Authentication required"],
    "translated": ["Cette page n'existe pas.", "Interner Serverfehler", "Página no encontrada", "Сервер временно недоступен", "页面未找到", "JavaScriptを有効にしてください"],
}
DEV_3_PLAIN = [
    "The loading dose was given over 30 minutes.",
    "Security of the data was ensured by encryption.",
    "The heading of the table lists the drugs.",
    "Connection to the monitor was checked every morning.",
    "All records were found in the regional archive.",
    "An error occurred in 2% of the infusions.",
    "Parents must be present when the child is examined.",
    "The article was retracted because data could not be verified.",
    "Authentication of cell lines was done by STR profiling.",
    "The page was read aloud to children who could not read.",
    "Please take the tablets with water.",
    "Enable early treatment by screening newborns.",
    "Cookies and sweets were not allowed before the test.",
    "Your child may feel tired after the injection.",
    "Twelve families were not available at the second visit.",
    "The system was not able to detect short seizures.",
    "Too many participants were lost to follow-up.",
    "The requested sample size was not reached.",
    "The index case was found in a database of 450 families.",
    "Text mining was used to retrieve abstracts.",
    "We apologize for the error in the first version of Table 2.",
    "Time to response was longer in the placebo group.",
    "The server at the canteen recorded what children ate.",
    "Refresh rates of the screen were 60 Hz.",
    "The form was completed by 85% of the parents.",
    "Replace the cap after each use.",
    "The session lasted 45 minutes.",
    "Here we report a case of early onset.",
    "Click-evoked potentials were normal.",
    "Le service de neurologie a suivi 40 enfants.",
    "Die Seite der Lähmung wechselte in drei Fällen.",
]

DEV_4 = {
    "network": ["Unable to reach the server. Check your internet connection.", "The request timed out.", "Host not found", "Network error: please try again."],
    "library portal": ["This content is restricted to subscribers.", "The document you requested is not available.", "You don't have permission to view this document.", "Item not found in the archive."],
    "status pages": ["HTTP 500 - Internal server error", "Error 403 - Forbidden", "410 Gone", "The service is temporarily unavailable. Please try again later."],
    "maintenance": ["Our website is currently down for scheduled maintenance.", "We will be back soon.", "This page is under construction."],
    "bot walls": ["Checking your browser before accessing the site.", "Please verify that you are a human.", "Your IP address has been blocked."],
    "exceptions": ["ValueError: invalid literal for int() with base 10: 'x'", "KeyError: 'section'", "RuntimeError: maximum recursion depth exceeded", "panic: runtime error: index out of range", "Caused by: java.io.IOException: Broken pipe"],
    "database": ["ERROR: relation \"articles\" does not exist", "MySQL server has gone away", "Query failed: syntax error near SELECT"],
    "crash notices": ["Sorry, something went wrong.", "An unexpected error occurred. Please reload the page.", "This page isn't working"],
    "forms": ["[Your abstract here]", "Enter your text here", "Click here to add a caption", "Insert figure legend", "<insert drug name>"],
    "drafts": ["Text to be added.", "Abstract to follow.", "Placeholder text", "TBD", "Summary coming soon."],
    "mail": ["Dear {{name}},", "Dear [FIRST NAME], your request {{id}} has been received.", "Hello ${user}, your results are ready.", "Kind regards, {{sender}}"],
    "latin": ["Lorem ipsum dolor sit amet", "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris", "qwerty qwerty"],
    "scripts": ["JavaScript is required to view this page.", "Please allow scripts in your browser settings.", "You have JavaScript disabled.", "This application needs JavaScript to run.", "Turn on JavaScript to see the figures."],
    "spinner": ["Loading...  please wait", "If the page does not load, enable JavaScript."],
    "translated": ["Bitte versuchen Sie es später noch einmal.", "Veuillez activer JavaScript.", "Error interno del servidor", "Доступ запрещён", "服务器内部错误", "サーバーエラーが発生しました"],
}
DEV_4_PLAIN = [
    "Gone are the days when children were sedated for an EEG.",
    "The request for approval was made in May.",
    "A second dose was required in 12 patients.",
    "The archive of the institute holds 400 samples.",
    "Network analysis found three clusters.",
    "Runtime of the assay was 40 minutes.",
    "The host response was measured by ELISA.",
    "Pages of the diary were scanned by a nurse.",
    "The drug was not available in two countries.",
    "Invalid samples were excluded.",
    "Human embryos were not used.",
    "The index was out of the normal range in 8 infants.",
    "Blocked channels recovered within minutes.",
    "You should not stop the medicine by yourself.",
    "Wait two hours before the next dose.",
    "Enter the study number on every page of the form.",
    "Maintenance treatment was started after 8 weeks.",
    "The legend explains the colours of the figure.",
    "We will report long-term results soon.",
    "Internal consistency was good.",
    "Please see the supplement for details.",
    "The summary was read by all authors.",
    "Access was gained through the femoral vein.",
    "Children were asked to reload the toy car.",
    "The view of the parents was that sleep had improved.",
    "Bei vier Kindern wurde die Dosis später erhöht.",
    "Un service de garde a été organisé.",
    "Broken appointments were counted.",
    "Description of the cohort has been published.",
    "Load-dependent changes were seen in slices.",
]

HELD_OUT = {
    "network": ["The connection was reset.", "Server not found", "No internet connection. Please check your network.", "The requested URL could not be retrieved."],
    "portal": ["This article is temporarily unavailable.", "You are not authorized to access this page.", "The file could not be opened.", "We couldn't find the page you were looking for."],
    "codes": ["HTTP 404: Page not found", "Error 502", "429 Too Many Requests", "401 - Unauthorized: Access is denied"],
    "maintenance": ["We are performing scheduled maintenance.", "The archive is offline for maintenance, please try again later.", "Service unavailable due to maintenance."],
    "bots": ["Please confirm you are not a robot.", "Access denied: too many requests from your network.", "Complete the security check to continue."],
    "exceptions": ["IndexError: list index out of range", "AttributeError: 'NoneType' object has no attribute 'text'", "java.io.FileNotFoundException: /data/article.xml (No such file or directory)", "Unhandled exception: TimeoutError", "fatal error: out of memory"],
    "sql": ["ERROR: column \"title\" does not exist", "Could not connect to the database.", "SQL syntax error near 'FROM'"],
    "apology": ["Sorry, an error occurred. Please try again.", "Oops, this page could not be found.", "Something went wrong while loading this article."],
    "forms": ["[Enter title here]", "Type your abstract here", "Click to enter text", "Add caption here", "Your name here"],
    "drafts": ["Discussion to be written.", "This section is a placeholder.", "Text goes here", "Table coming soon.", "Insert reference here"],
    "mail": ["Dear Dr. {{last_name}},", "Hi {first_name}, thanks for your submission.", "Your manuscript {{ms_id}} has been received.", "Best wishes, ${editor_name}"],
    "fields": ["Title: {{title}}", "Keywords: <<keyword1>>, <<keyword2>>", "Age: {{age}}, Sex: {{sex}}", "<%= section.body %>"],
    "filler": ["Lorem ipsum dolor sit amet, consetetur sadipscing elitr", "Duis aute irure dolor in reprehenderit", "asdf qwerty asdf"],
    "scripts": ["Please enable JavaScript to continue.", "This site needs JavaScript. Please enable it in your browser.", "JavaScript is turned off in your browser.", "Your browser doesn't support scripts.", "Enable scripts to view the full text."],
    "waiting": ["Please wait while the page is loading.", "Loading article...", "You are being redirected.", "Checking your browser..."],
    "translated": ["Seite nicht gefunden", "Zugriff verweigert", "Page non trouvée", "Veuillez activer JavaScript pour continuer.", "Por favor, habilite JavaScript.", "Ошибка сервера", "页面不存在"],
}
HELD_OUT_PLAIN = [
    "Connections between the thalamus and cortex were reset by sleep.",
    "The file of each patient was opened by two nurses.",
    "Service providers were not told about group allocation.",
    "The archive was searched for cases of early onset.",
    "Maximum doses were reached within two weeks.",
    "Access to the trial was limited to children under six.",
    "The system failed to detect 4 of 20 seizures.",
    "Users of the diary were asked to confirm each entry.",
    "The full text is written in plain language.",
    "Error correction was applied to all reads.",
    "The record shows that the child was seizure free.",
    "Hosts were infected with 10 parasites each.",
    "Time limits of the test were not exceeded.",
    "Scripts of the interviews were read by two coders.",
    "Out of 40 members, 12 had a positive test.",
    "The key finding is a lower rate of falls.",
    "Please shake the bottle before use.",
    "Your pharmacist can answer questions about storage.",
    "Loading with phenytoin was not needed.",
    "Not available: genotype data for two siblings.",
    "The site of injection was checked for redness.",
    "A placeholder tablet was given to controls.",
    "The section was stained and examined.",
    "Broken sleep was common in both groups.",
    "Server and client cells exchange metabolites in this model.",
    "The session was closed after all items were answered.",
    "We were unable to confirm the diagnosis in two cases.",
    "Data are available from the corresponding author.",
    "The name of the drug was hidden from raters.",
    "Ce service accueille des enfants épileptiques.",
]
