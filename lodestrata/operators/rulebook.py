"""The table of security rules, by language family.

Patterns have no lookaround, so that the same text works in Java's and in RE2's dialect. Rules on
``bare`` see code whose string contents are taken out: ``""`` stands for any literal there, so a call
with a literal, a variable, a concatenation or a format is told apart by what follows the bracket.
New rules are rows: a type, a severity, a pattern and the languages it is for.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """literal: one of these, between bars, is in every match, in lower case; also: has to fit the line too; guard: lines that it
    fits are exempt; near: has to fit the line or one beside it; languages: none for all."""

    type: str
    severity: str
    pattern: str
    literal: str = ""
    guard: str = ""
    languages: tuple[str, ...] = ()
    on: str = "code"
    also: str = ""
    near: str = ""


WEB = ("py", "js", "html")
#: A literal that something is added to or formatted into, or a formatted literal.
MADE = r'(""\s*(\+|%|\.\s*format)|f"")'
USER = r"(request\.(args|form|values|json|files|get|cookies|query|GET|POST)|params\[|args\[|form\[|input\s*\(|sys\.argv)"
SQL_WORDS = r"(?i)\b(select|insert|update|delete|order\s+by|from)\b"
SECRET_NAME = r"(password|passwd|pwd|api_?key|access_?key|secret_?key|secret|token|credentials?)"

RULES = [
    # Python, and the pages it makes
    Rule("sql-injection", "critical", rf"\b(execute|executemany|query|raw)\s*\(\s*{MADE}", "execute|query|raw", "", ("py", "js"), "bare"),
    Rule("sql-injection", "critical", r"(?i)\bf[\"'][^\"']*\b(select\s.*\sfrom|insert\s+into|update\s.*\sset|delete\s+from|drop\s+table)\b[^\"']*\{", "{", r"\?", ("py",)),
    Rule("command-injection", "critical", rf"\bos\.(system|popen)\s*\(\s*([A-Za-z_]|{MADE})", "os.system|os.popen", "", ("py",), "bare"),
    Rule("command-injection", "critical", r"\bsubprocess\.\w+\s*\(.*shell\s*=\s*True", "shell", "", ("py",), "bare"),
    Rule("command-injection", "critical", rf"\bsubprocess\.(call|run|Popen|check_output|check_call)\s*\(\s*({MADE}|[A-Za-z_][\w.]*\s*\+)", "subprocess", "", ("py",), "bare"),
    Rule("path-traversal", "high", r"(^|[^\w.])open\s*\(\s*(\"\"\s*\+|[A-Za-z_][\w.]*\s*\+|request\.)", "open", r"\bdef\s+open", ("py",), "bare"),
    Rule("path-traversal", "high", rf"\b(os\.path\.join|open|send_file|Path)\s*\([^)]*{USER}", "request|params[|args[|form[|input|sys.argv", "", ("py",), "bare"),
    Rule("path-traversal", "high", r"\b(remove|unlink|rmtree|copyfile)\s*\(\s*(\"\"\s*\+|[A-Za-z_][\w.]*\s*\+)", "remove|unlink|rmtree|copyfile", "", ("py",), "bare"),
    Rule("path-traversal", "high", r"\b(tarfile\.open|send_file)\s*\(\s*([A-Za-z_]|\"\"\s*\+)", "tarfile|send_file", "", ("py",), "bare"),
    Rule("path-traversal", "high", r"\.extractall\s*\([^)]*(\+|\(?\s*[A-Za-z_]\w*\s*\))", "extractall", "", ("py",), "bare"),
    Rule("zip-slip", "high", r"\bzipfile\.ZipFile\b|\.extract(all)?\s*\(\s*[A-Za-z_]", "zipfile|.extract", r"\bre\.\w+\s*\(", ("py",), "bare"),
    Rule("unsafe-deserialisation", "critical", r"\b(pickle|cPickle|marshal)\.loads?\s*\(|\bshelve\.open\s*\(|__import__\s*\([^)]*\)\s*\.\s*loads?\s*\(", "pickle|marshal|shelve|__import__", "", ("py",), "bare"),
    Rule("unsafe-deserialisation", "critical", r"\byaml\.(unsafe_)?load\s*\(", "yaml", r"SafeLoader", ("py",), "bare"),
    Rule("template-injection", "high", r"(\.from_string|(^|[^\w])Template)\s*\(\s*([A-Za-z_]|f\"\")|\brender_template_string\s*\(\s*(f\"\"|.*\+)", "from_string|template", "", ("py",), "bare"),
    Rule("dynamic-exec", "critical", r"(^|[^\w.])(eval|exec)\s*\(\s*[^\s\"'()]", "eval|exec", r"\bdef\s+(eval|exec)\b", WEB, "bare"),
    Rule("dynamic-exec", "critical", r"\b__import__\s*\(\s*[A-Za-z_]|(__dict__\s*\[[^\]]*\]|\b(globals|locals|vars)\s*\(\s*\)\s*\[[^\]]*\])\s*\(", "__import__|__dict__|globals|locals|vars", "", ("py",), "bare"),
    Rule("dynamic-exec", "critical", r"getattr\s*\(\s*(__builtins__|builtins)\s*,\s*[\"'](eval|exec|execfile|compile)[\"']", "getattr", "", ("py",)),
    Rule("hardcoded-secret", "high", rf"(?i)\b\w*{SECRET_NAME}\w*\s*[=:]\s*[\"'][^\"']{{6,}}[\"']", "pass|pwd|key|secret|token|credential", r"(?i)[\"'][^\"']*(todo|your_own|your_secret|your_key|your_password|change_?me|placeholder|example)"),
    Rule("hardcoded-secret", "high", r"[\"']ghp_[A-Za-z0-9]{20,}[\"']|(^|[^A-Z0-9])AKIA[0-9A-Z]{16}([^A-Z0-9]|$)|[\"']eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}[\"']|[\"']xox[abp]-[A-Za-z0-9-]{10,}[\"']", "ghp_|akia|eyj|xox"),
    Rule("hardcoded-secret", "high", r"[a-z]+://[^:/\s\"']+:[^@/\s\"']{4,}@|-----BEGIN [A-Z ]*PRIVATE KEY", "://|private key"),
    Rule("weak-crypto", "medium", r"\.new\s*\([^)]*MODE_ECB|\bRSA\.generate\s*\(\s*(\d{1,3}|1\d{3}|20[0-3]\d|204[0-7])\s*\)|=\s*b[\"'](\\x00|0)+[\"']\s*\*", "mode_ecb|rsa.generate|b'|b\"", "", ("py",)),
    Rule("weak-hash", "medium", r"\bhashlib\.(md5|sha1)\s*\(", "hashlib", "", ("py",), "bare", "", r"(?i)(password|passwd|pwd|credential|secret|auth)"),
    Rule("timing-attack", "medium", r"(?i)(password|passwd|pwd|secret|token|hash)\s*==\s*", "==", "", ("py", "js"), "bare"),
    Rule("insecure-random", "high", r"\brandom\.(random|randint|randrange|choice|uniform|sample)\s*\(", "random", "", ("py",), "bare", "", r"(?i)(password|token|secret|code|key|nonce|salt|otp|captcha|verify)"),
    Rule("redos", "high", r"\bre\.(compile|match|search|findall|fullmatch|sub|finditer|split)\s*\(.*\([^()?]*[+*]\s*\)\s*[+*]", "re.compile|re.match|re.search|re.findall|re.fullmatch|re.sub|re.finditer|re.split", "", ("py",)),
    Rule("crlf-injection", "medium", rf"(headers\s*\[|set_cookie|add_header).*{USER}|f[\"'].*(Location|Set-Cookie).*\{{", "headers|set_cookie|add_header|location|set-cookie", "", ("py",)),
    Rule("temp-file", "medium", r"\bopen\s*\([^)]*[\"']/tmp/", "/tmp/", "", ("py",)),
    Rule("temp-file-race", "high", r"\btempfile\.mktemp\s*\(", "mktemp", "", ("py",), "bare"),
    Rule("xss", "high", r"\.(innerHTML|outerHTML|srcdoc)\s*=([^=]|$)|\bdocument\.write(ln)?\s*\(|\binsertAdjacentHTML\s*\(|\bdangerouslySetInnerHTML\b|\bv-html\s*=", "innerhtml|outerhtml|srcdoc|document.write|insertadjacenthtml|dangerouslysetinnerhtml|v-html", "", WEB, "bare"),
    Rule("xss", "high", r"\brender_template_string\s*\(|(^|[^\w])Markup\s*\(|\b(auto)?escape\s*=\s*False", "render_template_string|markup|escape", "", ("py",), "bare"),
    Rule("xss", "high", r"[\"'][^\"']*</?[a-zA-Z][^\"']*[\"']\s*\+|\|\s*safe\b", "'+|' +|\"+|\" +|safe", r"\bescape\s*\(|markupsafe", WEB),
    Rule("debug-mode", "medium", r"\bDEBUG\s*=\s*True|\bapp\.run\s*\([^)]*debug\s*=\s*True", "debug", "", ("py",), "bare"),
    Rule("ssrf", "high", rf"\b(requests|httpx)\.(get|post|put|delete|head|patch|stream)\s*\(\s*({MADE}|[A-Za-z_][\w.]*\s*\+|{USER})", "requests|httpx", "", ("py",), "bare"),
    Rule("ssrf", "high", rf"\burlopen\s*\(\s*({MADE}|{USER})|\bHTTPConnection\s*\(\s*[A-Za-z_]|\bhttpx\.\w+\s*\(\s*[A-Za-z_]", "urlopen|httpconnection|httpx", "", ("py",), "bare"),
    Rule("ssrf", "high", r"\b(requests|httpx|urllib)\.\w+\s*\(\s*[\"']https?://(169\.254\.|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)", "http", "", ("py",)),
    Rule("cors", "medium", r"Access-Control-Allow-Origin.{0,50}(\*|request)", "allow-origin", "", WEB),
    Rule("xxe", "high", r"\b(etree|ET|ElementTree|minidom|sax)\.(parse|parseString|XML|fromstring)\s*\(|\bexpat\.ParserCreate\s*\(|\bresolve_entities\s*=\s*True|\b(no_network|load_dtd)\s*=\s*False", "etree|et.parse|et.xml|et.fromstring|elementtree|minidom|sax|expat|resolve_entities|no_network|load_dtd", r"defusedxml", ("py",), "bare"),
    Rule("open-redirect", "medium", rf"\bredirect\s*\([^)]*{USER}|(?i)\blocation[\"'\]\s]*=\s*{USER}", "redirect|location", "", ("py", "js")),
    Rule("open-redirect", "medium", r"(?i)http-equiv\s*=\s*\\?[\"']refresh.*url\s*=[\\\"'\s]*[+{]", "refresh", "", WEB),
    Rule("jwt", "high", r"\bjwt\.decode\s*\([^)]*(verify\s*=\s*False|verify_signature[\"']?\s*:\s*False)|\bjwt\.\w+\s*\([^)]*algorithms?\s*=\s*\[?\s*[\"'](none|HS256)[\"']", "jwt", "", ("py", "js")),
    Rule("unverified-tls", "high", r"\bverify\s*=\s*False", "verify", r"\bjwt\.", ("py",), "bare"),
    # JavaScript
    Rule("command-injection", "critical", r"\bexec(Sync)?\s*\(\s*(\"\"\s*\+|[A-Za-z_$][\w$.]*\s*\+|`[^`]*\$\{)|\bspawn\s*\(\s*\"\"\s*,\s*\[?\s*\"\"\s*,\s*[A-Za-z_$]", "exec|spawn", "", ("js", "html"), "bare"),
    Rule("path-traversal", "high", r"\bfs\.\w+\s*\([^)]*\+", "fs.", "", ("js", "html"), "bare"),
    Rule("ssrf", "high", r"\b(fetch|got|axios\.(get|post|put|delete)|http\.(get|request))\s*\(\s*([A-Za-z_$]|\"\"\s*\+|`[^`]*\$\{)", "fetch|got|axios|http.", "", ("js", "html"), "bare"),
    Rule("prototype-pollution", "high", r"\.__proto__(\.[\w$]+)?\s*=([^=]|$)|\b(Object\.assign|merge|clone)\s*\([^)]*JSON\.parse|\[\s*\w+\s*\]\s*=\s*req\.", "__proto__|json.parse|req.", "", ("js", "html"), "bare"),
    Rule("regex-redos", "medium", r"/[^/]*\([^()?]*[+*]\)[+*][^/]*/|\bnew\s+RegExp\s*\([^)]*\)[+*]", ")+|)*|regexp", "", ("js", "html")),
    Rule("dynamic-exec", "high", r"\bnew\s+Function\s*\(\s*\S|\brequire\s*\(\s*[A-Za-z_$]|\bvm\.runIn\w+\s*\(|\(\s*0\s*,\s*eval\s*\)\s*\(", "function|require|runin|eval", "", ("js", "html"), "bare"),
    Rule("xss", "high", r"\.html\s*\(\s*[A-Za-z_$]", ".html", "", ("js", "html"), "bare"),
    # Java
    Rule("command-execution", "high", r"(\bnew\s+ProcessBuilder|\bRuntime\.getRuntime\(\)\.exec)\s*\((\s*\"\"\s*,)*\s*([A-Za-z_]|\"\"\s*\+)", "processbuilder|exec", r"new\s+String\s*\[\s*\]\s*\{(\s*\"\"\s*,?)*\}", ("java",), "bare"),
    Rule("unbounded-bind", "medium", r"(\bInetSocketAddress|\.bind)\s*\([^)]*[\"'](0\.0\.0\.0|::)[\"']", "0.0.0.0|::", "", ("java",)),
    Rule("sensor-rate", "low", r"\bregisterListener\s*\([^)]*,\s*2\s*,", "registerlistener", "", ("java",), "bare"),
    Rule("plaintext-secret", "medium", r"(?i)\bputString\s*\(.*(api[_ -]?key|token|passw|secret)", "putstring", "", ("java",)),
    Rule("hardcoded-key", "high", r"[\"']sk[_-][A-Za-z0-9_-]{12,}[\"']", "sk", "", ("java",)),
    Rule("permission-hint", "low", r"\bsetTorchMode\s*\(", "settorchmode", "", ("java",), "bare"),
    Rule("weak-guard", "high", r"\b(ShizukuShell\.exec|Runtime\.getRuntime\(\)\.exec|ProcessBuilder)\s*\(", "exec|processbuilder", "", ("java",), "bare", "", r"(?i)\b(isDangerous|confirmEnabled|allowRootShell|requireConfirm)\b"),
    Rule("secret-in-file", "medium", r"\b(Files\.write|FileOutputStream|openFileOutput)\s*\(", "files.write|fileoutputstream|openfileoutput", "", ("java",), "code", r"(?i)(api[_ -]?key|token|password|secret)"),
    Rule("file-deletion", "high", r"\bnew\s+File\s*\(\s*[A-Za-z_][^)]*\)\s*\.delete\w*\s*\(|\bFiles\.delete\s*\(\s*[A-Za-z_]", "delete", "", ("java",), "bare"),
    Rule("packer-hint", "low", r"(?i)(libjiagu|com\.qihoo\.util|com\.stub\.StubApp|360jiagu)", "libjiagu|qihoo|stubapp|360jiagu", "", ("java",)),
    Rule("sql-injection", "critical", r"\b(executeQuery|executeUpdate|prepareStatement|execute)\s*\([^)]*\+", "execute|preparestatement", "", ("java",), "code", SQL_WORDS),
    Rule("sql-injection", "critical", r"(?i)\bString\.format\s*\([^)]*\b(select|insert|update|delete|order\s+by)\b|@(Select|Update|Insert|Delete)\s*\(\s*\"[^\"]*\$\{", "string.format|@select|@update|@insert|@delete", "", ("java",)),
    Rule("sql-injection", "medium", r"(?i)\bnew\s+StringBuilder\s*\(\s*\"[^\"]*(select|from|insert|update|delete)\s", "stringbuilder", "", ("java",)),
    Rule("xss", "high", r"\b(getWriter\(\)\.\w+|getOutputStream\(\)\.print|out\.print(ln)?)\s*\([^)]*(\brequest\.|\breq\.|\+)", "getwriter|getoutputstream|out.print", r"escape\w*\s*\(", ("java",), "bare"),
    Rule("xss", "medium", r"\bsetAttribute\s*\([^,]*,\s*(request|req)\.", "setattribute", "", ("java",), "bare"),
    Rule("path-traversal", "high", r"\b(new\s+File|FileInputStream|FileReader|FileOutputStream|FileWriter|Paths\.get)\s*\([^)]*\+|\b(FileChannel\.open|Files\.\w+\s*\(\s*Paths\.get)\s*\(\s*[A-Za-z_]", "file|paths", "", ("java",), "bare"),
    Rule("xxe", "high", r"\b(DocumentBuilderFactory|SAXParserFactory)\.newInstance\(\)", "newinstance", "", ("java",), "bare"),
    Rule("unsafe-deserialisation", "critical", r"\bnew\s+ObjectInputStream\b|\breadObject\s*\(\s*\)", "objectinputstream|readobject", "", ("java",), "bare"),
    Rule("ssrf", "high", r"\bnew\s+(java\.net\.)?(URL|Socket)\s*\(\s*([A-Za-z_]|\"\"\s*\+)|\bHttpURLConnection\b", "url|socket", "", ("java",), "bare"),
    Rule("weak-crypto", "medium", r"(?i)\bgetInstance\s*\(\s*[\"'](MD5|SHA-?1|DES|RC4|AES/ECB)", "getinstance", "", ("java", "kotlin")),
    Rule("insecure-config", "high", r"\baddJavascriptInterface\s*\(", "addjavascriptinterface", "", ("java", "kotlin"), "bare"),
    Rule("dynamic-exec", "high", r"\b(ScriptEngineManager|getEngineBy\w+)\s*\(|\bparseExpression\s*\(\s*[A-Za-z_]", "scriptenginemanager|getengineby|parseexpression", "", ("java",), "bare"),
    # C and C++
    Rule("command-injection", "critical", r"(^|[^\w])(system|popen)\s*\(\s*([A-Za-z_]|\"\"\s*[A-Z_])", "system|popen", "", ("c",), "bare"),
    Rule("buffer-overflow", "critical", r"(^|[^\w])gets\s*\(", "gets", "", ("c",), "bare"),
    Rule("buffer-overflow", "high", r"(^|[^\w])(strcpy|strcat)\s*\([^,;]*,\s*[^\s\"A-Z]", "strcpy|strcat", "", ("c",), "bare"),
    Rule("buffer-overflow", "medium", r"(^|[^\w])sprintf\s*\([^,;]*,\s*([A-Za-z_]|\"[^\"]*%[0-9.]*[duxXcfs])", "sprintf", "", ("c",)),
    Rule("buffer-overflow", "high", r"(^|[^\w])f?scanf\s*\([^;]*\"[^\"]*%s", "scanf", "", ("c",)),
    # PHP, Go, Rust, Kotlin
    Rule("sql-injection", "critical", r"(?i)(mysqli_query\s*\(|->\s*(query|exec|prepare)\s*\(|\bquery\s*\(|\$\w+\s*=\s*[\"']\s*(select|insert|update|delete)).*(\$\w|\.\s*\$)", "mysqli_query|->|query|select|insert|update|delete", r"=\s*\?|\?\s*[,)]|\(\s*\?", ("php",), "code", SQL_WORDS),
    Rule("command-injection", "critical", r"\b(system|exec|shell_exec|passthru|popen|proc_open)\s*\([^)]*\$\w", "system|exec|popen|passthru", r"escapeshell(arg|cmd)", ("php",)),
    Rule("dangerous-upload", "high", r"\bmove_uploaded_file\s*\([^)]*\$_FILES|\bmove_uploaded_file\s*\([^)]*\.\s*\$", "move_uploaded_file", "", ("php",)),
    Rule("unsafe-deserialisation", "critical", r"\bunserialize\s*\(\s*\$", "unserialize", r"allowed_classes", ("php",)),
    Rule("weak-crypto", "medium", r"\b(md5|sha1)\s*\(\s*\$\w*(pass|pwd|secret|token)", "md5|sha1", "", ("php",)),
    Rule("path-traversal", "high", r"\b(include|require)(_once)?\s*\(?\s*[^;]*\$\w|\b(file_get_contents|fopen|readfile|unlink)\s*\(\s*\$_(GET|POST|REQUEST)", "include|require|file_get_contents|fopen|readfile|unlink", r"\bbasename\s*\(", ("php",)),
    Rule("xss", "high", r"\b(echo|print)\b[^;]*\$_(GET|POST|REQUEST|COOKIE)", "$_", r"htmlspecialchars|htmlentities", ("php",)),
    Rule("command-injection", "critical", r"\bexec\.Command(Context)?\s*\([^)]*(\"\"\s*,\s*\"\"\s*,\s*[A-Za-z_]|\+|Sprintf)", "command", "", ("go",), "bare"),
    Rule("sql-injection", "critical", r"\.(Query|QueryRow|Exec)(Context)?\s*\([^)]*(\"\"\s*\+|[A-Za-z_]\w*\s*\+|fmt\.Sprintf)", "query|exec", "", ("go",), "bare"),
    Rule("sql-injection", "critical", r"(?i)\bfmt\.Sprintf\s*\(\s*[\"`](select|insert|update|delete)\s[^\"`]*%", "sprintf", "", ("go",)),
    Rule("ssrf", "high", r"\bhttp\.(Get|Post|Head|PostForm)\s*\(\s*([A-Za-z_]|\"\"\s*\+)|\bhttp\.NewRequest\s*\([^,]*,\s*[A-Za-z_]", "http.", "", ("go",), "bare"),
    Rule("command-injection", "critical", r"\bCommand::new\s*\(\s*(&?[a-z_]\w*|format!)|\.arg\s*\(\s*(&?\s*)format!\s*\(|\.arg\s*\(\s*\"\"\s*\)\s*\.arg\s*\(\s*&?[a-z_]", "command::new|.arg", "", ("rust",), "bare"),
    Rule("sql-injection", "critical", r"(?i)\bformat!\s*\(\s*\"\s*(select|insert|update|delete)\s[^\"]*\{", "format!", "", ("rust",)),
    Rule("unsafe-code", "low", r"\bunsafe\s*(\{|fn\b|impl\b)", "unsafe", "", ("rust",), "bare"),
    Rule("command-injection", "critical", r"\bRuntime\.getRuntime\(\)\.exec\s*\(\s*([A-Za-z_]|\"\"\s*\+)|\bProcessBuilder\s*\((\s*\"\"\s*,)*\s*[A-Za-z_]", "exec|processbuilder", "", ("kotlin",), "bare"),
    Rule("sql-injection", "critical", r"\b(rawQuery|execSQL)\s*\(\s*(\"\"\s*\+|[A-Za-z_]\w*\s*\+)", "rawquery|execsql", "", ("kotlin",), "bare"),
    Rule("sql-injection", "critical", r"\b(rawQuery|execSQL)\s*\(\s*\"[^\"]*\$", "rawquery|execsql", "", ("kotlin",)),
    Rule("unsafe-load", "medium", r"\b(DexClassLoader|PathClassLoader)\s*\(|\bSystem\.load\s*\(\s*[A-Za-z_]", "classloader|system.load", "", ("kotlin", "java"), "bare"),
    # special files
    Rule("key-leak", "high", r"(?i)^[^#=]*(key|token|secret|password|passwd|api|credential)[^=]*=\s*\S{8,}", "=", "", ("env",)),
    Rule("unpinned-dependency", "low", r"^\s*[A-Za-z][\w.-]*", "", r"==|~=|^\s*[#\-\[]", ("requirements",)),
]


@dataclass(frozen=True)
class FileRule:
    """One finding for a file, at the first line that ``present`` fits, where ``also`` fits some
    line (if given) and ``absent`` none (if given)."""

    type: str
    severity: str
    present: str
    languages: tuple[str, ...]
    also: str = ""
    absent: str = ""


FILE_RULES = [
    FileRule("auth-bypass", "high", r"(?i)@(app\.route|bp\.route|router\.\w+|\w*\.route)\s*\(.*(delete|remove|drop|admin|reset|secret|token|password|grant|upload|export)", ("py",), "", r"@\w*(login_required|auth|permission|jwt_required|token_required|admin_required|require_admin|ensure_admin|is_authenticated|requires_auth)"),
    FileRule("deny-list", "medium", r"(?i)String\[\]\s*\w+\s*=\s*\{[^}]*\"(rm\s+-|bank|wallet|alipay|unionpay|paypal|wipe|erase|format|secret)", ("java",), r"\.(contains|indexOf)\s*\(\s*[A-Za-z_]\w*"),
    FileRule("sql-injection", "medium", r"\.append\s*\(\s*[A-Za-z_]", ("java",), r"\bexecute\w*\s*\("),
]
