"""Signature registries and the numeric rules built on them.

The tables below are FIXED VALUES: names, patterns, severities, weights and
their order define the results, so they are stated plainly and in order.
Patterns use Python ``re`` notation and are matched case-insensitively;
``riskloom.functions.matching`` turns them into Java patterns with the same
meaning.

``needs`` lists triggers (see ``TRIGGERS``) that must all be present in a
line before the pattern can match.  It never changes a result; it only lets
the scan skip a regular expression that cannot succeed.
"""

from __future__ import annotations

from typing import NamedTuple


class Signature(NamedTuple):
    name: str
    pattern: str
    needs: tuple[str, ...]
    severity: str = ""
    kind: str = ""          # entry-point type, or attack type of a sink
    weight: int = 0         # shortcut signatures only


# A trigger is present when the case-folded line contains any of its literals.
TRIGGERS: dict[str, tuple[str, ...]] = {
    "eval": ("eval",),
    "exec": ("exec",),
    "os": ("os.",),
    "subprocess": ("subprocess.",),
    "pickle": ("pickle.",),
    "yaml": ("yaml.",),
    "render": ("render_template_string",),
    "redirect": ("redirect",),
    "verb": ("select", "insert", "update", "delete"),
    "fverb": ("select", "insert", "update", "delete", "from"),
    "quote": ("'", '"'),
    "plus": ("+",),
    "brace": ("{",),
    "percent": ("%",),
    "paren": ("(",),
    "assign": ("=",),
    "star": ("*",),
    "dollar": ("$",),
    "format": (".format",),
    "document": ("{", ".find"),
    "except": ("except",),
    "print": ("print", "debug", "console.log"),
    "bypass": ("bypass", "skip", "remove"),
    "guard": ("auth", "login", "check"),
    "runner": ("eval", "exec", "os.system"),
    "credential": ("password", "secret", "api_key", "token"),
    "pass": ("password", "passwd", "pwd"),
    "api": ("api",),
    "token": ("token", "bearer"),
    "secret": ("secret", "private_key"),
    "verify": ("verify",),
    "hashlib": ("hashlib.",),
    "random": ("random.",),
    "debug": ("debug",),
    "cors": ("cors", "allowed_hosts", "access-control-allow-origin"),
    "marker": ("todo", "fixme", "debug", "temp", "hack", "xxx"),
    "request": ("req", "$_", "json()"),
    "upload": ("upload_folder", "request.", ".save", "$_"),
    "save": (".save",),
    "input": ("input", "sys.argv", "scanner"),
    "argv": ("sys.argv",),
    "route": ("app", "router", "blueprint", "api"),
    "user": ("user_",),
    "data": ("data",),
    "payload": ("payload",),
    "cmd": ("cmd",),
    "query": ("query",),
    "open": ("open",),
}

# --- FIXED VALUES: vulnerability signatures, first match wins -------------
VULNERABILITIES: tuple[Signature, ...] = (
    Signature("Dangerous Execution (eval)", r"\beval\s*\(", ("eval", "paren"), "High"),
    Signature("Dangerous Execution (exec)", r"\bexec\s*\(", ("exec", "paren"), "High"),
    Signature("System Command Execution (os.system)", r"os\.system\s*\(", ("os", "paren"), "High"),
    Signature("Subprocess Execution",
              r"subprocess\.(Popen|call|run|check_output|getoutput)\s*\(", ("subprocess", "paren"), "High"),
    Signature("Insecure Deserialization (pickle)", r"pickle\.loads\s*\(", ("pickle", "paren"), "High"),
    Signature("Insecure Deserialization (yaml)", r"yaml\.load\s*\(", ("yaml", "paren"), "High"),
    Signature("Insecure Template Rendering", r"render_template_string\s*\(", ("render", "paren"), "High"),
    Signature("Open Redirect", r"redirect\s*\(\s*request\.(args|form|json|values)", ("redirect", "paren"), "High"),
    Signature("SQL Injection (Concatenation)",
              r"['\"].*(SELECT|INSERT|UPDATE|DELETE).*['\"]\s*\+|\+\s*['\"].*(SELECT|INSERT|UPDATE|DELETE)",
              ("verb", "quote", "plus"), "High"),
    Signature("SQL Injection (f-string)",
              r"f['\"].*(SELECT|INSERT|UPDATE|DELETE|FROM\s+\w+\s+WHERE).*\{", ("fverb", "quote", "brace"), "High"),
    Signature("SQL Injection (.format)",
              r"['\"].*(SELECT|INSERT|UPDATE|DELETE).*['\"]\s*\.format\s*\(", ("verb", "quote", "format"), "High"),
    Signature("SQL Injection (% formatting)",
              r"['\"].*(SELECT|INSERT|UPDATE|DELETE).*['\"]\s*%", ("verb", "quote", "percent"), "High"),
    Signature("NoSQL Injection (MongoDB $where)",
              r"\$where.*?(request|req|input|args|params|body|query|user|data)", ("dollar",), "High"),
    Signature("NoSQL Injection (dynamic operator)",
              r"\{\s*(request|req|input|args|params|body|user).*\$"
              r"|\.find\s*\(\s*(request|req|input|args|body)", ("document",), "High"),
    Signature("Hardcoded Password", r"(password|passwd|pwd)\s*=\s*['\"][^'\"]{3,}['\"]",
              ("pass", "assign", "quote"), "Medium"),
    Signature("Hardcoded API Key", r"(api_key|apikey|api[-_]key)\s*=\s*['\"][^'\"]{6,}['\"]",
              ("api", "assign", "quote"), "Medium"),
    Signature("Hardcoded Token", r"(token|auth_token|access_token|bearer)\s*=\s*['\"][^'\"]{6,}['\"]",
              ("token", "assign", "quote"), "Medium"),
    Signature("Hardcoded Secret", r"(secret|secret_key|private_key)\s*=\s*['\"][^'\"]{3,}['\"]",
              ("secret", "assign", "quote"), "Medium"),
    Signature("SSL Verification Disabled", r"verify\s*=\s*False", ("verify", "assign"), "Medium"),
    Signature("Weak Hashing (MD5)", r"hashlib\.md5\s*\(", ("hashlib", "paren"), "Medium"),
    Signature("Weak Hashing (SHA1)", r"hashlib\.sha1\s*\(", ("hashlib", "paren"), "Medium"),
    Signature("Insecure Random (random module)", r"\brandom\.(randint|random|choice|shuffle)\s*\(",
              ("random", "paren"), "Low"),
    Signature("Debug Mode Enabled", r"(app\.run\s*\(.*debug\s*=\s*True|DEBUG\s*=\s*True)",
              ("debug", "assign"), "Medium"),
    Signature("Wildcard CORS / Allowed Hosts",
              r"(ALLOWED_HOSTS|cors.*origin|Access-Control-Allow-Origin)\s*[=:]\s*['\"]?\*",
              ("cors", "star"), "Medium"),
    Signature("Suspicious Keyword", r"\b(TODO|FIXME|DEBUG|TEMP|HACK|XXX)\b", ("marker",), "Low"),
)

# --- FIXED VALUES: entry-point signatures, first match wins ---------------
ENTRY_POINTS: tuple[Signature, ...] = (
    Signature("API JSON Body", r"(request\.json|request\.get_json|req\.body|json\(\))",
              ("request",), "High", "API Input"),
    Signature("Form Data", r"(request\.form|request\.values|\$_POST|req\.body)", ("request",), "High", "Form Data"),
    Signature("Query Parameters", r"(request\.args|request\.params|\$_GET|\$_REQUEST|req\.query)",
              ("request",), "Medium", "Query Parameter"),
    Signature("File Upload Handler", r"(request\.files|\$_FILES|upload_folder|\.save\s*\()",
              ("upload",), "High", "File Upload"),
    Signature("HTTP Headers", r"request\.(headers|cookies)", ("request",), "Medium", "HTTP Header/Cookie"),
    Signature("Console Input", r"(\binput\s*\(|sys\.argv|Scanner\s*\(\s*System\.in\s*\))",
              ("input",), "Low", "User Input"),
    Signature("Flask/FastAPI Route", r"@(app|router|blueprint|api)\.(route|get|post|put|delete|patch)\s*\(",
              ("route", "paren"), "Info", "Route Handler"),
    Signature("Express.js Route", r"(app|router)\.(get|post|put|delete|all)\s*\(",
              ("route", "paren"), "Info", "Route Handler"),
    Signature("PHP Superglobal Input", r"\$_(GET|POST|REQUEST|FILES|COOKIE|SERVER)\[",
              ("dollar",), "High", "PHP Input"),
)

# --- FIXED VALUES: where outside data enters (bit = position) --------------
SOURCES: tuple[Signature, ...] = (
    Signature("request.args", r"request\.args", ("request",)),
    Signature("request.form", r"request\.form", ("request",)),
    Signature("request.json", r"request\.json", ("request",)),
    Signature("request.files", r"request\.files", ("request",)),
    Signature("req.body", r"req\.body", ("request",)),
    Signature("$_GET", r"\$_GET", ("dollar",)),
    Signature("$_POST", r"\$_POST", ("dollar",)),
    Signature("$_REQUEST", r"\$_REQUEST", ("dollar",)),
    Signature("input()", r"\binput\s*\(", ("input", "paren")),
    Signature("sys.argv", r"sys\.argv", ("argv",)),
    Signature("user_input", r"\buser_input\b", ("user",)),
    Signature("user_data", r"\buser_data\b", ("user",)),
    Signature("data", r"\bdata\s*=", ("data", "assign")),
    Signature("payload", r"\bpayload\b", ("payload",)),
    Signature("cmd", r"\bcmd\s*=", ("cmd", "assign")),
    Signature("query", r"\bquery\s*=", ("query", "assign")),
)

RCE = "Remote Code Execution (RCE)"
SSTI = "Server-Side Template Injection"
DESERIALIZATION = "Unsafe Deserialization"
COMMAND = "Command Injection"
SQL = "SQL Injection"
UPLOAD = "Unsafe File Upload"
FILE_HANDLING = "Unsafe File Handling"

# --- FIXED VALUES: dangerous calls and the attack they enable --------------
SINKS: tuple[Signature, ...] = (
    Signature("eval()", r"\beval\s*\(", ("eval", "paren"), kind=RCE),
    Signature("exec()", r"\bexec\s*\(", ("exec", "paren"), kind=RCE),
    Signature("os.system()", r"os\.system\s*\(", ("os", "paren"), kind=COMMAND),
    Signature("subprocess", r"subprocess\.(Popen|call|run|check_output)\s*\(", ("subprocess", "paren"), kind=COMMAND),
    Signature("os.popen()", r"os\.popen\s*\(", ("os", "paren"), kind=COMMAND),
    Signature("pickle.loads()", r"pickle\.loads\s*\(", ("pickle", "paren"), kind=DESERIALIZATION),
    Signature("yaml.load()", r"yaml\.load\s*\(", ("yaml", "paren"), kind=DESERIALIZATION),
    Signature("SQL f-string", r"f['\"].*(SELECT|INSERT|UPDATE|DELETE).*\{", ("verb", "quote", "brace"), kind=SQL),
    Signature("SQL concatenation", r"(SELECT|INSERT|UPDATE|DELETE).*\+", ("verb", "plus"), kind=SQL),
    Signature("file open()", r"\bopen\s*\(\s*(request|req|\$_)", ("open", "paren"), kind=FILE_HANDLING),
    Signature("file.save()", r"\.save\s*\(", ("save", "paren"), kind=UPLOAD),
    Signature("render_template_string()", r"render_template_string\s*\(", ("render", "paren"), kind=SSTI),
)

# --- FIXED VALUES: shortcut signatures, searched in the whole file text ----
SHORTCUTS: tuple[Signature, ...] = (
    Signature("No Input Validation (direct use)",
              r"(eval|exec|os\.system)\s*\(\s*\w*(input|request|req|args|form|json|body)\w*", ("runner", "paren"), weight=15),
    Signature("Hardcoded Credential", r"(password|secret|api_key|token)\s*=\s*['\"][^'\"]{3,}['\"]",
              ("credential", "assign", "quote"), weight=10),
    Signature("Bare Except Clause", r"except\s*:", ("except",), weight=5),
    Signature("Shell=True in Subprocess", r"shell\s*=\s*True", ("assign",), weight=12),
    Signature("Debug Code in Production", r"(print\s*\(.*password|debug\s*=\s*True|console\.log.*token)",
              ("print",), weight=7),
    Signature("SQL Concatenation",
              r"['\"].*(SELECT|INSERT|UPDATE|DELETE).*['\"]\s*\+|\+\s*['\"].*(SELECT|INSERT|UPDATE|DELETE)",
              ("verb", "quote", "plus"), weight=15),
    Signature("SSL Disabled", r"verify\s*=\s*False", ("verify", "assign"), weight=10),
    Signature("Wildcard CORS", r"Access-Control-Allow-Origin.*\*", ("cors", "star"), weight=8),
    Signature("MD5 for Passwords", r"md5\s*\(.*password", ("pass", "paren"), weight=12),
    Signature("Auth Bypass Comment", r"(#|//|/\*).*?(bypass|skip|remove).*?(auth|login|check)", ("bypass", "guard"), weight=8),
)

# --- FIXED VALUES: scan limits and file rules ------------------------------
class Registry(NamedTuple):
    """The signatures that a scan looks for; replace any of them to look for others.

    At most 31 sources and 31 sinks, since a line keeps them as bits.  ``triggers`` has the literals of every name
    that a signature ``needs``, beside those of the given signatures; a signature that needs nothing is tried on every line.
    """

    vulnerabilities: tuple[Signature, ...] = VULNERABILITIES
    entry_points: tuple[Signature, ...] = ENTRY_POINTS
    sources: tuple[Signature, ...] = SOURCES
    sinks: tuple[Signature, ...] = SINKS
    shortcuts: tuple[Signature, ...] = SHORTCUTS
    triggers: dict[str, tuple[str, ...]] = TRIGGERS

    def literals(self, name: str) -> tuple[str, ...]:
        return self.triggers[name] if name in self.triggers else TRIGGERS[name]

    def line_signatures(self) -> tuple[Signature, ...]:
        return (*self.vulnerabilities, *self.entry_points, *self.sources, *self.sinks)


DEFAULT = Registry()

SOURCE_WINDOW = 15                 # lines between a source and a later sink
CODE_WIDTH = 120                   # characters of code kept with a match
MAX_FILE_BYTES = 1024 * 1024
MAX_FILES = 500
CONTEXT_LINES = 5

SCANNED_EXTENSIONS = (".py", ".js", ".ts", ".php", ".java", ".c", ".cpp", ".cs", ".rb",
                      ".go", ".rs", ".html", ".txt", ".sh", ".env", ".yml", ".yaml")
SKIPPED_DIRECTORIES = ("node_modules", "__pycache__", "dist", "build", "venv")
LANGUAGES = {".py": "Python", ".js": "JavaScript", ".php": "PHP", ".java": "Java", ".txt": "Text/Unknown"}

FINDING_COMMENTS = ("#", "//", "/*")
CHAIN_COMMENTS = ("#", "//")
STATS_COMMENTS = ("#", "//", "/*", "*", "<!--")
IMPORT_PREFIXES = ("import ", "from ", "include ", "require ", "#include")
FUNCTION_PREFIXES = ("def ", "function ", "public ", "private ", "protected ", "async function ")
CLASS_PREFIXES = ("class ",)

# --- FIXED VALUES: issue groups --------------------------------------------
SECRET_ISSUES = ("Hardcoded Password", "Hardcoded API Key", "Hardcoded Token", "Hardcoded Secret")
DANGEROUS_ISSUES = (
    "Dangerous Execution (eval)", "Dangerous Execution (exec)", "System Command Execution (os.system)",
    "Subprocess Execution", "Insecure Deserialization (pickle)", "Insecure Deserialization (yaml)",
    "Insecure Template Rendering",
)

# --- FIXED VALUES: chain order and severity --------------------------------
ATTACK_ORDER = (RCE, SSTI, DESERIALIZATION, COMMAND, SQL, UPLOAD, FILE_HANDLING)
ATTACK_SEVERITY = {
    RCE: "Critical", SSTI: "Critical", DESERIALIZATION: "Critical",
    COMMAND: "High", SQL: "High", UPLOAD: "High",
    FILE_HANDLING: "Medium",
}

# --- FIXED VALUES: scoring -------------------------------------------------
SEVERITY_POINTS = {"High": 25, "Medium": 10, "Low": 2}
PRIORITY_BASE = {"High": 50, "Medium": 25, "Low": 5}
PRIORITY_BONUS = {"chain": 30, "input": 15, "secret": 20, "ml_high": 15, "ml_medium": 7}
PRIORITY_STEPS = ((80, "Critical"), (50, "High"), (20, "Medium"))
PRIORITY_ORDER = ("Critical", "High", "Medium", "Low")
FILE_STEPS = ((80, "Critical"), (45, "High"), (15, "Medium"))
GRADE_STEPS = ((90, "A"), (75, "B"), (55, "C"), (35, "D"))
HIGH_RISK, MEDIUM_RISK, SAFE = "High Risk", "Medium Risk", "Safe"

# --- FIXED VALUES: points, caps and steps of the repository scores ---------
VIBE_FACTORS = ("High Severity Issues", "Hardcoded Secrets", "Attack Chains", "Insecure Shortcuts",
                "Exposed Attack Surface")
VIBE_POINTS = {"high": (7, 35), "secrets": (8, 20), "chains": (10, 25), "shortcuts": (1, 15), "high_inputs": (1, 5)}     # points each, cap
VIBE_STEPS = ((30, "Low Risk"), (70, "Medium Risk"))        # up to and including; above, High Risk
MATURITY_POINTS = {"high": 15, "medium": 7, "secrets": 10, "sql_issues": 8}
MATURITY_ENTRIES, MATURITY_ENTRY_POINTS, MATURITY_CLEAN_BONUS = 5, 10, 10
MATURITY_STEPS = ((75, "Advanced"), (45, "Intermediate"))   # else Beginner
GRADE_DEDUCTIONS = {"critical_priority": 8, "high_priority": 3, "chains": 5}
GRADE_VIBE_STEPS = ((80, 15), (60, 10))                     # above this vibe score, so many points
ML_POINTS = (20, 10)                                        # off the base score for High and Medium Risk

COMPOSITE_CHAIN, COMPOSITE_CHAIN_CAP = 30, 60               # points of a chain in a file's composite score, and their cap
COMPOSITE_ML = (20, 10)                                     # points of a file classified High and Medium Risk
INDICATOR_COMMENTS, INDICATOR_FUNCTIONS = 10, 3             # more than these count as indicators of maturity

# --- FIXED VALUES: how many rows a result bundle shows per repository ------
RESULT_CAPS = {"findings": 200, "prioritized_findings": 200, "entry_points": 100,
               "attack_chains": 50, "ranked_files": 50, "file_risks": 10}


def bits(signatures: tuple[Signature, ...], wanted) -> int:
    """Bit mask of the signatures for which ``wanted(signature)`` holds."""
    return sum(1 << i for i, s in enumerate(signatures) if wanted(s))
