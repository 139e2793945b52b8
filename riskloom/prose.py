"""Texts attached to results: descriptions, advice, report sentences.

Names of issues and attack types are fixed; the wording is this library's own.
"""

from __future__ import annotations

from riskloom import registry as R

ISSUE_DESCRIPTIONS: dict[str, str] = {
    "Dangerous Execution (eval)": "A string is evaluated as code; whoever controls the string controls the process.",
    "Dangerous Execution (exec)": "Code assembled at run time is executed.",
    "System Command Execution (os.system)": "A command line is handed to the system shell.",
    "Subprocess Execution": "A child process is started; shell mode or outside arguments allow injected commands.",
    "Insecure Deserialization (pickle)": "Unpickling foreign bytes can run code while the object is rebuilt.",
    "Insecure Deserialization (yaml)": "A YAML load without the safe loader may construct arbitrary objects.",
    "Insecure Template Rendering": "A template is compiled from a string, so injected template syntax is executed.",
    "Open Redirect": "The redirect target is taken from the request and can point to a foreign site.",
    "SQL Injection (Concatenation)": "A statement is glued together with +; bind the values instead.",
    "SQL Injection (f-string)": "Values are interpolated into a statement; bind the values instead.",
    "SQL Injection (.format)": "Values are formatted into a statement; bind the values instead.",
    "SQL Injection (% formatting)": "Values are spliced into a statement with %; bind the values instead.",
    "NoSQL Injection (MongoDB $where)": "A $where expression that depends on outside data runs as script in the database.",
    "NoSQL Injection (dynamic operator)": "Request data is used as a query document, so operators can be smuggled in.",
    "Hardcoded Password": "A password is written into the source, readable by anyone with the file.",
    "Hardcoded API Key": "A service key is written into the source.",
    "Hardcoded Token": "An access token is written into the source.",
    "Hardcoded Secret": "A signing or encryption secret is written into the source.",
    "SSL Verification Disabled": "Certificates are not checked, so the connection can be intercepted.",
    "Weak Hashing (MD5)": "MD5 collisions are practical; use SHA-256, or a password hash for passwords.",
    "Weak Hashing (SHA1)": "SHA-1 is retired for security use; use SHA-256 or newer.",
    "Insecure Random (random module)": "Predictable random numbers; use a cryptographic generator for secrets.",
    "Debug Mode Enabled": "Debug mode shows internals and may offer a console to visitors.",
    "Wildcard CORS / Allowed Hosts": "A wildcard admits every origin or host.",
    "Suspicious Keyword": "A developer marker points at unfinished work.",
}

CHAIN_DESCRIPTIONS: dict[str, str] = {
    R.RCE: "Outside input reaches a call that executes code.",
    R.COMMAND: "Outside input reaches a command line.",
    R.SQL: "Outside input becomes part of a database statement.",
    R.DESERIALIZATION: "Outside bytes are turned back into objects by an unsafe loader.",
    R.UPLOAD: "An uploaded file is stored without a check of its kind.",
    R.FILE_HANDLING: "Outside input chooses the file that is opened.",
    R.SSTI: "Outside input becomes part of a server-side template.",
}
CHAIN_ALERTS: dict[str, str] = {
    R.RCE: "CRITICAL: input can flow into executed code.",
    R.COMMAND: "HIGH: input can flow into a shell command.",
    R.SQL: "HIGH: input can flow into an unbound query.",
    R.DESERIALIZATION: "CRITICAL: input can flow into an unsafe deserializer.",
    R.UPLOAD: "HIGH: an uploaded file is saved unchecked.",
    R.FILE_HANDLING: "MEDIUM: input can select files outside the intended folder.",
    R.SSTI: "CRITICAL: input can flow into a rendered template.",
}

# issue -> why_dangerous, real_world_risk, attack_possibility, secure_coding
EXPLANATIONS: dict[str, tuple[str, str, str, str]] = {
    "Dangerous Execution (eval)": (
        "The argument is run as a program, not read as data.",
        "High: control of the argument is control of the server.",
        "A request field holding an import expression starts a shell.",
        "Parse literals with ast.literal_eval or a purpose-built parser."),
    "Dangerous Execution (exec)": (
        "Whole statements are executed from a string.",
        "High: the process and its credentials are exposed.",
        "A stored script is replaced by one that reads the environment.",
        "Dispatch to known functions instead of running text."),
    "System Command Execution (os.system)": (
        "The shell interprets separators and substitutions inside the string.",
        "High: extra commands run with the rights of the service.",
        "A host name followed by a semicolon adds a second command.",
        "Call subprocess.run with a list of arguments and no shell."),
    "Subprocess Execution": (
        "A shell or unchecked arguments let input change the command.",
        "High when a shell is used or input reaches the arguments.",
        "A file name with shell syntax is expanded before the program starts.",
        "Pass a list, keep shell=False and check every argument."),
    "Insecure Deserialization (pickle)": (
        "A pickle may name any callable to be invoked on load.",
        "High: loading alone is enough, no further call is needed.",
        "A crafted cookie or message runs a command when it is read.",
        "Exchange data as JSON; sign pickles that stay internal."),
    "Insecure Deserialization (yaml)": (
        "Tags in the document may construct arbitrary objects.",
        "High: construction can execute code.",
        "A configuration upload carries an object tag.",
        "Use yaml.safe_load."),
    "Insecure Template Rendering": (
        "Template syntax inside the string is executed on the server.",
        "High: settings leak and code may run.",
        "A display name containing template braces prints the configuration.",
        "Render fixed template files and pass values as variables."),
    "SQL Injection (Concatenation)": (
        "Joined text can close the literal and continue the statement.",
        "High: rows can be read, changed or dropped.",
        "A quote followed by an always-true test returns every row.",
        "Use placeholders and pass the values separately."),
    "SQL Injection (f-string)": (
        "Interpolation puts raw text into the statement.",
        "High: same reach as concatenation.",
        "A numeric field carries an extra condition.",
        "Use placeholders or a query builder."),
    "SQL Injection (.format)": (
        "Formatting puts raw text into the statement.",
        "High: same reach as concatenation.",
        "A formatted identifier carries a second clause.",
        "Use placeholders instead of format fields."),
    "Hardcoded Password": (
        "Everyone who can read the file can read the password.",
        "Medium: direct access to the account behind it.",
        "A public copy of the repository is searched for assignments.",
        "Read the password from the environment or a vault."),
    "Hardcoded API Key": (
        "The key travels with every copy of the code.",
        "Medium to high: paid or private services are open.",
        "A leaked key is used until its quota is gone.",
        "Keep keys in a secrets manager and rotate them."),
    "Hardcoded Token": (
        "A token replaces a login for as long as it lives.",
        "Medium: actions are taken in the owner's name.",
        "A token found in history pushes changed code.",
        "Issue short-lived tokens at run time."),
    "Hardcoded Secret": (
        "The secret signs sessions or encrypts data.",
        "Medium to high: sessions can be forged.",
        "A forged cookie names an administrator.",
        "Load the secret at start and keep it out of the code."),
}
EXPLANATION_FALLBACK = (
    "The rules mark this construct as a possible weakness.",
    "The effect depends on where the data comes from; review it.",
    "It may be exploitable if outside data reaches it.",
    "Validate input and follow the guidance of the framework.",
)

# issue -> title, priority_action, insecure_example, secure_example, steps
RECOMMENDATIONS: dict[str, tuple[str, str, str, str, tuple[str, ...]]] = {
    "Dangerous Execution (eval)": (
        "Parse instead of evaluating", "Take eval() out of every path that sees input.",
        "n = eval(text)", "n = ast.literal_eval(text)",
        ("Find out what kind of value is expected.", "Choose a parser for that kind.", "Reject everything else.")),
    "Dangerous Execution (exec)": (
        "Drop exec()", "Replace executed text by calls to known functions.",
        "exec(text)", "ACTIONS[name](event)",
        ("List the actions needed.", "Map names to functions.", "Refuse unknown names.")),
    "System Command Execution (os.system)": (
        "Start programs without a shell", "Switch to subprocess.run with a list.",
        "os.system('gzip ' + name)", "subprocess.run(['gzip', name], shell=False, check=True)",
        ("Split the command into arguments.", "Keep shell=False.", "Check arguments against an allow list.")),
    "Subprocess Execution": (
        "Keep the shell out of subprocess", "Remove shell=True.",
        "subprocess.run(line, shell=True)", "subprocess.run(shlex.split(line), shell=False)",
        ("Pass a list.", "Validate each argument.", "Set a timeout.")),
    "Insecure Deserialization (pickle)": (
        "Use a data-only format", "Stop unpickling anything received from outside.",
        "obj = pickle.loads(body)", "obj = json.loads(body)",
        ("Move the exchange to JSON.", "Authenticate internal pickles.", "Verify before loading.")),
    "Insecure Deserialization (yaml)": (
        "Use the safe YAML loader", "Call yaml.safe_load.",
        "cfg = yaml.load(text)", "cfg = yaml.safe_load(text)",
        ("Replace the call.", "Check the shape of the result.")),
    "Insecure Template Rendering": (
        "Render fixed templates", "Keep input out of template source.",
        "render_template_string(text)", "render_template('page.html', text=text)",
        ("Move templates to files.", "Pass input as variables.", "Leave escaping on.")),
    "Open Redirect": (
        "Redirect to known places only", "Check the target before redirecting.",
        "return redirect(request.args['to'])", "return redirect(TARGETS.get(request.args['to'], '/'))",
        ("List the permitted targets.", "Compare the host.", "Fall back to the start page.")),
    "Hardcoded Password": (
        "Read passwords from the environment", "Change the exposed password.",
        "password = 'letmein1'", "password = os.environ['DB_PASSWORD']",
        ("Remove the literal.", "Store it in a vault.", "Rotate it.")),
    "Hardcoded API Key": (
        "Read keys from the environment", "Revoke the exposed key.",
        "api_key = 'k-0000000'", "api_key = os.environ['SERVICE_KEY']",
        ("Revoke and reissue.", "Store it outside the repository.", "Scan the history for copies.")),
    "Hardcoded Token": (
        "Fetch tokens at run time", "Revoke the exposed token.",
        "token = 't-0000000'", "token = os.environ['SERVICE_TOKEN']",
        ("Revoke it.", "Use short lifetimes.")),
    "Hardcoded Secret": (
        "Load secrets at start", "Replace the exposed secret.",
        "secret_key = 'abc'", "secret_key = os.environ['APP_SECRET']",
        ("Generate a random value.", "Inject it at deployment.", "End existing sessions.")),
    "SQL Injection (Concatenation)": (
        "Bind values", "Replace joined statements by bound ones.",
        "run('SELECT * FROM t WHERE a=' + a)", "run('SELECT * FROM t WHERE a=?', (a,))",
        ("Add placeholders.", "Pass values as a tuple.", "Review every statement.")),
    "SQL Injection (f-string)": (
        "Bind values instead of interpolating", "Replace interpolated statements by bound ones.",
        "run(f'SELECT * FROM t WHERE a={a}')", "run('SELECT * FROM t WHERE a=?', (a,))",
        ("Search for f-strings that hold statements.", "Add placeholders.")),
    "SQL Injection (.format)": (
        "Bind values instead of formatting", "Replace formatted statements by bound ones.",
        "run('SELECT * FROM t WHERE a={}'.format(a))", "run('SELECT * FROM t WHERE a=?', (a,))",
        ("Search for format calls on statements.", "Add placeholders.")),
    "SSL Verification Disabled": (
        "Check certificates", "Remove verify=False.",
        "get(url, verify=False)", "get(url, verify='/etc/ssl/own-ca.pem')",
        ("Remove the switch.", "Install the issuing certificate.")),
    "Weak Hashing (MD5)": (
        "Replace MD5", "Do not use MD5 where safety depends on it.",
        "hashlib.md5(data)", "hashlib.sha256(data)",
        ("Use SHA-256 for checksums.", "Use a password hash for passwords.", "Re-hash on next login.")),
    "Weak Hashing (SHA1)": (
        "Replace SHA-1", "Move to SHA-256.",
        "hashlib.sha1(data)", "hashlib.sha256(data)",
        ("Replace the call.", "Refresh stored digests.")),
    "Debug Mode Enabled": (
        "Turn debug mode off", "Set debug to false before release.",
        "app.run(debug=True)", "app.run(debug=False)",
        ("Read the flag from the environment.", "Check error pages.")),
    "Insecure Random (random module)": (
        "Use a cryptographic generator", "Use the secrets module for tokens.",
        "code = random.randint(0, 9999)", "code = secrets.randbelow(10000)",
        ("Find values that must not be guessed.", "Draw them from secrets.")),
    "Wildcard CORS / Allowed Hosts": (
        "Name the permitted origins", "Replace the wildcard.",
        "ALLOWED_HOSTS = ['*']", "ALLOWED_HOSTS = ['www.example.org']",
        ("List the origins.", "Allow credentials only where needed.")),
    "Unsafe File Upload": (
        "Check uploads", "Check kind and name before saving.",
        "f.save(f.filename)", "f.save(store / secure_filename(f.filename))",
        ("Allow known kinds.", "Choose the name on the server.", "Store outside the web root.")),
    "Suspicious Keyword": (
        "Settle open markers", "Fix each marker or file it as work.",
        "check(user)  # TODO", "check(user)",
        ("List the markers.", "Fix or track each one.")),
}
# The title gets the issue name appended.
RECOMMENDATION_FALLBACK = (
    "Review: ", "Review the code against common guidance.",
    "# see the matched line", "# apply the framework's safe alternative",
    ("Look for a safer construct.", "Consult OWASP material.", "Ask for a second review."),
)

# FIXED VALUES: label and colour; the explanation is our own.
GRADES: dict[str, tuple[str, str, str]] = {
    "A": ("Excellent", "#10B981", "Little exposure and sound practice."),
    "B": ("Good", "#34D399", "Sound overall, with some minor points."),
    "C": ("Average", "#FBBF24", "Moderate weaknesses that should be planned in."),
    "D": ("Poor", "#F87171", "Serious weaknesses; start with the critical findings."),
    "F": ("Failing", "#EF4444", "Several ways to break in; do not deploy."),
}

# Sentences of the repository narrative; %d is a count.
NARRATIVE: dict[str, str] = {
    "rce": "CRITICAL: %d path(s) from outside input to code execution.",
    "command": "HIGH RISK: %d path(s) from outside input to a shell command.",
    "sql": "HIGH RISK: %d path(s) from outside input into database statements.",
    "deserialization": "HIGH RISK: outside data is deserialized by an unsafe loader.",
    "upload": "MEDIUM RISK: uploaded files are stored without checks.",
    "secrets": "MEDIUM RISK: %d credential(s) are written into the source; rotate them.",
    "inputs": "NOTICE: %d places accept outside input.",
    "dangerous": "NOTICE: %d calls execute code or commands or rebuild objects.",
    "ml": "CLASSIFIER: %d file(s) resemble known vulnerable code.",
    "clear": "No path from input to a dangerous call and no exposed credential was found.",
}

ML_INDICATORS: dict[str, str] = {
    "execution": "Calls that execute code or commands",
    "sql": "Database statements built from text",
    "secret": "A credential written into the file",
    "deserialization": "Objects rebuilt by an unsafe loader",
    "chains": "%d path(s) from input to a dangerous call in this file",
    "density": "%d high-severity findings in one file",
    "fallback": "Token statistics close to risky training samples",
}
ML_SUMMARIES: dict[str, str] = {
    R.HIGH_RISK: "Classified as HIGH RISK with %s%% confidence; its tokens resemble vulnerable samples.",
    R.MEDIUM_RISK: "Classified as MEDIUM RISK with %s%% confidence; some patterns deserve a look.",
    R.SAFE: "Classified as SAFE with %s%% confidence; no strong resemblance to vulnerable samples.",
}

# Comment lines and explanations of the line fixes.
FIX_TEXT: dict[str, str] = {
    "ssl": "Certificate verification is switched on (verify=True).",
    "md5": "MD5 is replaced by SHA-256.",
    "sha1": "SHA-1 is replaced by SHA-256.",
    "debug": "Debug mode is switched off.",
    "yaml": "The safe YAML loader is used.",
    "pickle": "JSON is read instead of a pickle.",
    "eval": "Only literals are evaluated.",
    "exec": "The dynamic execution is disabled.",
    "exec_note": "# exec() disabled: replace it by calls to known functions.",
    "os": "The command is started by subprocess without a shell.",
    "subprocess": "The shell is switched off.",
    "env_python": "The value is read from os.getenv('%s').",
    "env_js": "The value is read from process.env.%s.",
    "random": "The number comes from the secrets module.",
    "sql": "Bind the values instead of building the statement from text.",
    "sql_note": "# Bind the values, e.g. cursor.execute('SELECT * FROM t WHERE a = ?', (a,))",
    "sql_original": "# Original: ",
    "default": "Review the line by hand and replace the risky construct.",
    "default_note": "# Review this line:",
}
