"""Rules on source texts of brace languages, Ruby and Python that need no syntax tree.

A text is cut once into comments, literals and the rest; three views of equal length follow, in which
parts are blanked, so that a pattern's place in a view is its place in the text. All of it is built-in
expressions over one row: no shuffle, no Python. Blocks are seen as far as one level of braces inside
them; deeper ones give no finding. A null text counts as empty; files of other languages give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import running
from ..functions.regex_facts import needed

_LINE, _BLOCK = r"//[^\n]*+", r"/\*.*?(?:\*/|\z)"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]++|\\.)*+"', r"'(?:[^'\\\n]++|\\.)*+'"
_CHAR = r"'(?:\\[^'\n]{1,10}|[^'\\\n])'"
_TICKS = r"`(?:[^`\\]++|\\.)*+`"
_PATTERN = r"(?<=[=(,:!&|?;\n] {0,2})/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/"

#: Comments and literals by language.
LEXEMES = {
    "javascript": ((_LINE, _BLOCK), (_DOUBLE, _SINGLE, _TICKS, _PATTERN)),
    "typescript": ((_LINE, _BLOCK), (_DOUBLE, _SINGLE, _TICKS, _PATTERN)),
    "csharp": ((_LINE, _BLOCK, r"(?<![^\n])[ \t]*+#[ \t]*+(?:if|elif|else|endif|region|endregion|define|undef|pragma|nullable|line|error|warning)\b[^\n]*+"), (r'@\$?"(?:[^"]++|"")*+"', _DOUBLE, _CHAR)),
    "go": ((_LINE, _BLOCK), (_DOUBLE, r"`[^`]*+`", _CHAR)),
    "rust": ((_LINE, _BLOCK), (r'\br(#*)".*?"\1', _DOUBLE, _CHAR)),
    "java": ((_LINE, _BLOCK), (r'"{3}(?:[^\\"]|\\.|"{1,2}(?!"))*+"{3}', _DOUBLE, _CHAR)),
    "python": ((r"#[^\n]*+",), (r'"{3}(?:[^\\"]|\\.|"{1,2}(?!"))*+"{3}', r"'{3}(?:[^\\']|\\.|'{1,2}(?!'))*+'{3}", _DOUBLE, _SINGLE)),
    "ruby": ((r"#[^\n{][^\n]*+", r"(?<![^\n])=begin\b.*?(?:\n=end\b[^\n]*+|\z)"), (_DOUBLE, _SINGLE)),
}

_JS, _CS, _GO, _RS, _RB, _JV, _PY = "javascript typescript", "csharp", "go", "rust", "ruby", "java", "python"
#: An import line's path, and an earlier argument of a call.
_IMPORT, _ARGUMENT = r"(?m)(?<=^[ \t]{0,8}|\bimport[ \t]{1,4})(?:(?!_[ \t]|import\b)[\w.]++[ \t]++)?", r"[^(),\n]{1,200},[ \t]{0,4}"
_END = r"(?=[ \t]*+(?:[;\n]|\z))"
_FLAT = r"(?:[^{}]|\{[^{}]*+\})*+"
_SHORT_KEY = r"(?:[1-9][0-9]{0,2}|1[0-9]{3}|20[0-3][0-9]|204[0-7])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_ACCESS = r"\b(?:public|private|protected|internal)(?:\s+(?:static|async|sealed|unsafe|new))*+\s+"

#: key, languages, view, pattern, message. Views: code (comments and insides of literals blank), plain (comments
#: blank), solid (as code, but comments filled in, so that a block with one isn't empty), comments (only these), text
#: (as it stands). Go rules take packages by their own names.
RULES = (
    ("S100", _JS, "code", r"\bfunction\s+[a-z$][A-Za-z0-9$]*_\w*", "Function name should be in camel case."),
    ("S100", _CS, "code", _ACCESS + r"[\w<>\[\],?]+\s+[a-z_]\w*\s*\(", "Method name should be in Pascal case."),
    ("S100", _GO, "code", r"\bfunc\s+(?:\([^()]*+\)\s*)?[A-Za-z0-9]+_\w*\s*\(", "Function name shouldn't have underscores."),
    ("S101", f"{_JS} {_CS}", "code", r"\bclass\s+(?:[a-z]\w*|[A-Z][A-Za-z0-9]*_\w*)", "Class name should be in Pascal case."),
    ("S106", _JS, "code", r"\bconsole\.(?:log|debug|info|warn|error)\s*\(", "Use a logger."),
    ("S106", _CS, "code", r"\bConsole\.(?:Write|WriteLine)\s*\(", "Use a logger."),
    ("S106", _RS, "code", r"\b(?:print|println|eprint|eprintln)!\s*[(\[{]", "Use a logger."),
    ("S107", _JS, "code", r"\bfunction\b\s*[\w$]*+\s*\((?:[^(),]*+,){7,}+[^()]*+\)", "Too many parameters."),
    ("S107", _CS, "code", _ACCESS + r"[^(){};=]*+\((?:[^(),]*+,){7,}+[^()]*+\)", "Too many parameters."),
    ("S107", _GO, "code", r"\bfunc\b(?:\s*\([^()]*+\))?\s*\w++\s*\((?:[^(),]*+,){7,}+[^()]*+\)", "Too many parameters."),
    ("S107", _RS, "code", r"\bfn\s+\w++(?:<[^<>]*+>)?\s*\((?:[^(),]*+,){7,}+[^()]*+\)", "Too many parameters."),
    ("S108", f"{_JS} {_CS}", "solid", r"\b(?:if|for|while|switch|using|lock)\s*\((?:[^(){}]|\([^(){}]*+\))*+\)\s*\{\s*\}|\b(?:else|try|finally|do)\s*\{\s*\}", "Fill in or remove this empty block."),
    ("S108", _GO, "solid", r"\b(?:if|for|switch)\b[^{}\n]*+\{\s*\}|\belse\s*\{\s*\}", "Fill in or remove this empty block."),
    ("S112", _CS, "code", r"\bthrow\s+new\s+(?:System\.)?(?:Exception|SystemException|ApplicationException|NullReferenceException|IndexOutOfRangeException)\s*\(", "Throw a more specific exception."),
    ("S122", f"{_JS} {_CS}", "code", r"(?m)^[ \t]*+(?!for\b)[^\n;(){}]*+(?:\([^()\n;]*+\)[^\n;(){}]*+)*+;[ \t]*+[A-Za-z_$][^\n;]*+;", "One statement a line."),
    ("S125", f"{_JS} {_CS}", "comments", r"//[^\n]*?[\w)\]'\"];[ \t]*+(?=\n|\z)|//[^\n]*?\)[ \t]*\{[ \t]*+(?=\n|\z)", "Remove this commented-out code."),
    ("S126", f"{_JS} {_CS} {_GO} {_RS}", "code", r"\belse\s+if\b[^{}]*+\{" + _FLAT + r"\}(?!\s*else\b)", "End the chain with an else."),
    ("S131", f"{_JS} {_CS} {_GO}", "code", r"\bswitch\b[^{}]*+\{(?:(?!\bdefault\b)[^{}]|\{[^{}]*+\})*+\}", "Add a default."),
    ("S1067", f"{_JS} {_CS} {_GO} {_RB}", "code", r"(?<![^{};&|,?\n])(?:[^{};&|,?\n]++(?:&&|\|\|)\s*+){4,}+[^{};&|,?\n]*+", "Condition has too many operators."),
    ("S1110", f"{_JS} {_CS} {_GO}", "code", r"\(\((?:[^()]|\([^()]*+\))*+\)\)", "Parentheses are doubled."),
    ("S1116", f"{_JS} {_CS} {_RS}", "code", r";[ \t]*+;(?=[ \t]*(?:\n|\}|\z))", "Statement is empty."),
    ("S1125", f"{_JS} {_CS} {_GO}", "code", r"[=!]==?\s*(?:true|false)\b|\b(?:true|false)\s*[=!]==?", "Compare without the literal."),
    ("S1186", _JS, "solid", r"\bfunction\b\s*[\w$]*+\s*\([^()]*+\)\s*\{\s*\}", "Fill in or explain this empty function."),
    ("S1186", _CS, "solid", _ACCESS + r"(?!override\b|virtual\b)[\w<>\[\],?]+\s+\w++\s*\([^()]*+\)\s*\{\s*\}", "Fill in or explain this empty method."),
    ("S1186", _GO, "solid", r"\bfunc\s+(?:\([^()]*+\)\s*)?\w++\s*\([^()]*+\)[^{}\n]*+\{\s*\}", "Fill in or explain this empty function."),
    ("S1264", f"{_JS} {_CS}", "code", r"\bfor\s*\(\s*;[^;(){}]+;\s*\)", "Use a while loop."),
    ("S1301", f"{_JS} {_CS}", "code", r"\bswitch\b[^{}]*+\{(?:(?!\bcase\b)[^{}])*+(?:\bcase\b(?:(?!\bcase\b)[^{}])*+){0,2}+\}", "Use an if."),
    ("S1313", f"{_JS} {_CS}", "plain", rf"([\"'`])(?!127\.|0\.0\.0\.0|255\.255\.255\.255|2\.5\.)(?:{_OCTET}\.){{3}}{_OCTET}(?:[:/][0-9]{{1,5}})?\1", "Make this address configurable."),
    ("S1314", f"{_JS} {_GO}", "code", r"(?<![\w.])0[0-7]+(?![\w.])", "Octal number."),
    ("S1479", f"{_JS} {_GO}", "code", r"\bswitch\b[^{}]*+\{(?:(?!\bcase\b)[^{}])*+(?:\bcase\b(?:(?!\bcase\b)[^{}])*+){31,}+\}", "Too many cases."),
    ("S1656", f"{_JS} {_CS} {_GO} {_RS}", "code", r"(?<![\w.$])(?<![\w.$][ \t])([A-Za-z_$][\w.$]*+)[ \t]*+=[ \t]*+\1(?![\w.$])(?=[ \t]*(?:;|\n|\z))", "Variable is assigned to itself."),
    ("S1763", f"{_JS} {_CS}", "code", r"(?=\b(?:return|throw|break|continue)\b)(?<=[;{}]\n[ \t]{0,60})(?:return|throw|break|continue)\b[^;{}\n]*+;\s*+(?!case\b|default\b|function\b|class\b)[A-Za-z_$]", "Code can't be reached."),
    ("S1764", f"{_JS} {_CS} {_GO} {_RS} {_RB}", "code", r"(?<![\w.$])(?=[A-Za-z_$][\w.$]*+\s*+[=!&|/%<>-])(?<=(?:[(,;{?\n]|\breturn|&&|\|\||\w =)[ \t]{0,4})([A-Za-z_$][\w.$]*+)\s*+(?:[=!]==?|&&|\|\||[-/%]|[<>]=?)\s*+\1(?![ \t]*[.\w$(\[*/%+-]|\s*[.*/%+-])", "Both sides are the same."),
    ("S1862", f"{_JS} {_CS} {_GO} {_RS}", "plain", r"\bif\s*([^{}]+?)\s*\{[^{}]*+\}\s*else\s+if\s*\1\s*\{", "Condition repeats the one before."),
    ("S1871", f"{_JS} {_CS} {_GO}", "plain", r"\bif\b[^{}]*+\{\s*+([^{}]*?[;\n][^{}]*?)\s*+\}\s*else\s+if\b[^{}]*+\{\s*\1\s*\}", "Two branches are the same."),
    ("S1940", f"{_JS} {_CS} {_GO}", "code", r"!\(\s*[\w.$]+\s*(?:[=!]==?|[<>]=?)\s*[\w.$]+\s*\)", "Use the opposite operator."),
    ("S2068", f"{_JS} {_CS}", "plain", r"(?i)\b\w*(?:password|passwd|pwd)\s*+[:=]\s*+[\"'][^\"'\n]+[\"']", "Password in the source."),
    ("S2092", _JS, "code", r"\bsecure\s*:\s*false\b", "Send this cookie over TLS only."),
    ("S2092", _CS, "code", r"\bSecure\s*=\s*false\b", "Send this cookie over TLS only."),
    ("S2208", _JS, "code", r"\bexport\s+\*\s+from\b", "Name what is exported."),
    ("S2208", _RS, "code", r"\buse\s+[\w:]+::\*\s*;", "Name what is imported."),
    ("S2245", _JS, "code", r"\bMath\.random\s*\(", "Pseudorandom numbers are predictable."),
    ("S2245", _CS, "code", r"\bnew\s+Random\s*\(", "Pseudorandom numbers are predictable."),
    ("S2612", _JS, "code", r"\bchmod(?:Sync)?\s*\([^()\n]*,\s*0o?[0-7]*[2367]\s*[,)]", "Others shouldn't get write permission."),
    ("S2737", f"{_JS} {_CS}", "solid", r"\bcatch\s*\(\s*(?:[\w.]+\s+)?(\w+)\s*\)\s*\{\s*throw(?:\s+\1)?\s*;?\s*\}", "This handler only throws again."),
    ("S2757", f"{_JS} {_CS} {_GO}", "code", r"(?<![=!<>+\-*/%&|^~:])=[+\-!][ \t]+(?=[\w$(])", "Was an augmented assignment meant?"),
    ("S3330", _JS, "code", r"\bhttpOnly\s*:\s*false\b", "Hide this cookie from scripts."),
    ("S3330", _CS, "code", r"\bHttpOnly\s*=\s*false\b", "Hide this cookie from scripts."),
    ("S3923", f"{_JS} {_CS} {_GO}", "plain", r"(?<!else )\bif\b[^{}]*+\{\s*+([^{}]+?)\s*+\}\s*else\s*\{\s*\1\s*\}", "All branches are the same."),
    ("S3981", f"{_JS} {_CS}", "code", r"\.(?:length|Length|Count|size)\s*(?:>=|<)\s*0(?![\w.])", "A size is never negative."),
    ("S4423", _JS, "plain", r"\bsecureProtocol\s*:\s*[\"'](?:TLSv1|TLSv1_1|SSLv[23])_method[\"']|\b(?:minVersion|maxVersion)\s*:\s*[\"']TLSv1(?:\.1)?[\"']", "Use a stronger protocol."),
    ("S4423", _CS, "code", r"\b(?:SslProtocols|SecurityProtocolType)\.(?:Ssl2|Ssl3|Tls|Tls11)\b", "Use a stronger protocol."),
    ("S4426", _JS, "code", rf"\bmodulusLength\s*:\s*{_SHORT_KEY}\b", "Use a longer key."),
    ("S4426", _CS, "code", rf"\bnew\s+[RD]SACryptoServiceProvider\s*\(\s*{_SHORT_KEY}\s*\)", "Use a longer key."),
    ("S4507", _JS, "code", r"\berrorhandler\s*\(\s*\)", "Turn debugging off."),
    ("S4507", _CS, "code", r"\bUseDeveloperExceptionPage\s*\(", "Turn debugging off."),
    ("S4790", _JS, "plain", r"\bcreateHash\s*\(\s*[\"'](?:md4|md5|sha1|ripemd160)[\"']", "Weak hash."),
    ("S4790", _CS, "code", r"\b(?:MD5|SHA1)(?:\.Create|CryptoServiceProvider|Managed)\s*\(", "Weak hash."),
    ("S4830", _JS, "code", r"\brejectUnauthorized\s*:\s*false\b", "Verify certificates."),
    ("S4830", _CS, "code", r"\bServerCertificate(?:Custom)?ValidationCallback\s*\+?=\s*(?:\([^()]*+\)|delegate[^{}]*+|\w++)\s*(?:=>\s*true\b|(?:=>\s*)?\{\s*return\s+true\s*;\s*\})", "Verify certificates."),
    ("S5122", _JS, "plain", r"[\"']Access-Control-Allow-Origin[\"']\s*[,:]\s*[\"']\*[\"']|\borigin\s*:\s*[\"']\*[\"']", "Check which origins are allowed."),
    ("S5122", _CS, "code", r"\bAllowAnyOrigin\s*\(", "Check which origins are allowed."),
    ("S5332", f"{_JS} {_CS}", "plain", r"[\"'`](?:http|ftp|telnet)://(?!localhost|127\.|\[?::1|www\.w3\.org|[\w.-]*\.?(?:example|test)(?=[/:\"'.]))[^\"'`\s]+", "Use an encrypted protocol."),
    ("S5443", f"{_JS} {_CS}", "plain", r"[\"'`]/(?:tmp|var/tmp|usr/tmp|dev/shm)(?:/[^\"'`\n]*+)?[\"'`]", "Folder is writable for all."),
    ("S5542", _JS, "plain", r"\bcreateCipheriv\s*\(\s*[\"'][\w-]+-ecb[\"']", "Use an authenticated mode."),
    ("S5542", _CS, "code", r"\bCipherMode\.ECB\b", "Use an authenticated mode."),
    ("S5547", _JS, "plain", r"\bcreateCipheriv\s*\(\s*[\"'](?:des|rc2|rc4|bf|blowfish)[\w-]*[\"']", "Use a strong cipher."),
    ("S5547", _CS, "code", r"\b(?:DES|TripleDES|RC2)(?:\.Create|CryptoServiceProvider)\s*\(", "Use a strong cipher."),
    ("S5659", _JS, "plain", r"\balgorithms?\s*:\s*\[?\s*[\"']none[\"']", "Sign and verify tokens."),
    ("S6418", f"{_JS} {_CS}", "plain", r"(?i)\b\w*(?:api_?key|auth_?token|secret|token)\s*+[:=]\s*+[\"'][\w+/=-]{20,}[\"']", "Secret in the source."),
    ("S1134", _JV, "comments", r"(?m)^(?:(?!(?i:fixme))[^\n])*+(?<!\p{L})(?i:fixme)(?!\p{L})[^\n]*+$", "Take the required action."),
    ("S1135", _JV, "comments", r"(?m)^(?:(?!(?i:todo))[^\n])*+(?<!\p{L})(?i:todo)(?!\p{L})[^\n]*+$", "Complete the task."),
    ("S2211", _JV, "code", r"(?<=\()\w+(?:\s*,\s*\w+){2,}(?=\s*\)\s*->)|(?<=\()\w+(?:\s*,\s*\w+)?(?=\s*\)\s*->\s*\{)|(?<![\w.])(?<!\bcase )\w+(?=\s*->\s*\{)", "Give the parameters their types."),
    ("S1134", _RB, "comments", r"(?<![\p{L}0-9])(?<!(?<![\p{L}0-9])(?i:fixme)(?![\p{L}0-9])[^\n]{1,300})(?i:fixme)(?![\p{L}0-9])", "Take the required action."),
    ("S1135", _RB, "comments", r"(?<![\p{L}0-9])(?<!(?<![\p{L}0-9])(?i:todo)(?![\p{L}0-9])[^\n]{1,300})(?i:todo)(?![\p{L}0-9])", "Complete the task."),
    ("S126", _RB, "code", r"\belsif\b(?=[^\n]*+\n(?:(?!\b(?:elsif|else|end|if|unless|case|while|until|do|def|begin)\b)[\s\S])*+\bend\b)", "End the chain with an else."),
    ("S1309", _PY, "comments", r"(?m)#(?=(?:[^#\n]*#)*?[ \t]*+(?:noqa(?=[\s;:]|$)|(?i:nosec)(?![A-Za-z0-9_])))[^\n]*+", "Does this hide a problem?"),
    ("S1291", _JS, "comments", r"//[^\n]*?NOSONAR[^\n]*+|/\*(?:(?!\*/)[\s\S])*?NOSONAR(?:(?!\*/)[\s\S])*+\*/", "Fix what this comment hides."),
    ("G114", _GO, "code", r"\bhttp\.(?:Serve|ListenAndServe|ListenAndServeTLS)(?=\()", "Use a server with timeouts."),
    ("G116", _GO, "text", r"[\u061C\u200E\u200F\u202A-\u202E\u2066-\u2069]", "Remove this control character."),
    ("G112", _GO, "code", r"\bhttp\.Server(?=\{(?:(?!\bReadHeaderTimeout\b)[^{}])*+\})", "Set a time limit for headers."),
    ("G124", _GO, "code", r"\bhttp\.Cookie(?=\{(?!(?=[^{}]*\bSecure\s*:\s*true\b)(?=[^{}]*\bHttpOnly\s*:\s*true\b)[^{}]*\bSameSite\s*:\s*http\.SameSite(?:Lax|Strict)Mode\b)(?:\s*\}|[^{}]*:[^{}]*\}))", "Set Secure, HttpOnly and SameSite."),
    ("G301", _GO, "code", r"(?<=\bos\.Mkdir(?:All)?\(" + _ARGUMENT + r")(?!0o?0*(?:[0-7]?[0145])?0(?!\w))0o?[0-7]+(?=[ \t]*\))", "Permissions are wider than 0750."),
    ("G302", _GO, "code", r"(?<=\bos\.Chmod\(" + _ARGUMENT + r")(?!0o?0*[0246]?0?0(?!\w))0o?[0-7]+(?=[ \t]*\))", "Permissions are wider than 0600."),
    ("G303", _GO, "plain", r"(?<=\b(?:os|ioutil)\.(?:Create|WriteFile)\([ \t]{0,4})[\"`]/(?:usr/|var/)?tmp(?:/[^\"`\n]*+)?[\"`]", "This path can be foreseen."),
    ("G306", _GO, "code", r"(?<=\b(?:os|ioutil)\.WriteFile\(" + 2 * _ARGUMENT + r")(?!0o?0*[0246]?0?0(?!\w))0o?[0-7]+(?=[ \t]*\))", "Permissions are wider than 0600."),
    ("G307", _GO, "code", r"\bos\.Create(?=\()", "Open files with a mode."),
    ("G401", _GO, "plain", _IMPORT + r'"crypto/(?:md5|sha1)"' + _END, "Weak hash."),
    ("G402", _GO, "code", r"\bInsecureSkipVerify(?=[ \t]*:[ \t]*true\b)", "Verify certificates."),
    ("G403", _GO, "code", r"(?<=\brsa\.GenerateKey\(" + _ARGUMENT + r")(?:[0-9]{1,3}|1[0-9]{3}|20[0-3][0-9]|204[0-7])(?=[ \t]*\))", "Use a longer key."),
    ("G405", _GO, "plain", _IMPORT + r'"crypto/(?:des|rc4)"' + _END, "Use a strong cipher."),
    ("G406", _GO, "plain", _IMPORT + r'"golang\.org/x/crypto/(?:md4|ripemd160)"' + _END, "Weak hash."),
    ("SA1004", _GO, "code", r"(?<=\btime\.Sleep\([ \t]{0,4})(?:[1-9][0-9]?|1[01][0-9]|120)(?=[ \t]*\))", "Give the unit of time."),
    ("permissions-set-readonly-false", _RS, "code", r"\bset_readonly(?=\s*\(\s*false\s*\))", "Anyone may write then."),
    ("no-async-promise-executor", _JS, "code", r"(?<=\bnew Promise\(\s{0,8})async\b(?=\s*(?:\(|function\b|\w+\s*=>))", "Take async away."),
    ("CA2026", _CS, "code", r"(?<=\bJsonDocument\.Parse\([^()\n]{1,200}\)\.)RootElement\b", "Parse the element itself."),
)

#: Code-quality queries by their registered ids: a profile of its own, which no other profile contains.
QUALITY_RULES = (
    ("js/conditional-comment", _JS, "comments", r"/\*@(?:cc_on|if|else|end|set)\b", "Conditional comments are gone."),
    ("js/shift-out-of-range", _JS, "code", r"(?:<<|>>>?)=?[ \t]*(?:3[2-9]|[4-9][0-9]|[1-9][0-9]{2,})(?![\w.])", "Shift is wider than its operand."),
    ("js/with-statement", _JS, "code", r"(?<![.\w$])with[ \t]*(?=\()", "Name the object instead."),
    ("js/duplicate-parameter-name", _JS, "code", r"\bfunction\b[ \t]*[\w$]*[ \t]*\((?:[^()]*[,(\s])?([A-Za-z_$][\w$]*)[ \t]*,(?:[^()]*,)?[ \t]*\1[ \t]*(?=[,)])", "Parameter occurs twice."),
    ("cs/call-to-gc", _CS, "code", r"\bGC\.Collect[ \t]*(?=\()", "Leave this to the runtime."),
    ("cs/catch-nullreferenceexception", _CS, "code", r"\bcatch[ \t]*\([ \t]*(?:System\.)?NullReferenceException\b", "Test for null instead."),
    ("cs/class-implements-icloneable", _CS, "code", r"\b(?:class|struct|record)\s+\w+(?:<[^<>]*>)?\s*:[^{;]*?\bICloneable\b", "Cloning may be deep or shallow."),
    ("cs/empty-lock-statement", _CS, "solid", r"\block[ \t]*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:\{\s*\}|;)", "Lock guards nothing."),
    ("cs/lock-this", _CS, "code", r"\block[ \t]*\([ \t]*this[ \t]*\)", "Others may lock this too."),
    ("cs/type-test-of-this", _CS, "code", r"\bthis[ \t]+is[ \t]+(?!not\b|null\b)[A-Z]\w*", "Override a method instead."),
    ("go/mistyped-exponentiation", _GO, "code", r"(?<![\w.])(?:2|10)[ \t]*\^[ \t]*[0-9]+(?![\w.])", "This is an exclusive or."),
    ("go/negative-length-check", _GO, "code", r"\b(?:len|cap)\([\w.]+\)[ \t]*(?:<[ \t]*0|<=[ \t]*-[0-9]+|==[ \t]*-[0-9]+)(?![\w.])", "A length is never negative."),
    ("go/shift-out-of-range", _GO, "code", r"\bu?int(?:8\([\w.]+\)[ \t]*(?:<<|>>)[ \t]*(?:[89]|[1-9][0-9]+)|16\([\w.]+\)[ \t]*(?:<<|>>)[ \t]*(?:1[6-9]|[2-9][0-9]|[1-9][0-9]{2,})|32\([\w.]+\)[ \t]*(?:<<|>>)[ \t]*(?:3[2-9]|[4-9][0-9]|[1-9][0-9]{2,}))(?![\w.])", "Shift is wider than its operand."),
    ("go/redundant-recover", _GO, "code", r"\bdefer[ \t]+recover\(\)", "Recover in a deferred function."),
    ("java/call-to-thread-run", _JV, "code", r"\bnew[ \t]+Thread\([^()]*\)\.run\(\)", "Start the thread instead."),
    ("java/comparison-with-nan", _JV, "code", r"[=!]=[ \t]*(?:Double|Float)\.NaN\b|\b(?:Double|Float)\.NaN[ \t]*[=!]=", "Use isNaN."),
    ("java/do-not-call-finalize", _JV, "code", r"(?<!\bsuper)\.finalize\(\)", "Leave this to the runtime."),
    ("java/inefficient-boxed-constructor", _JV, "code", r"\bnew[ \t]+(?:Integer|Long|Short|Byte|Character|Boolean|Double|Float)[ \t]*(?=\()", "Use valueOf."),
    ("java/inefficient-empty-string-test", _JV, "plain", r"\.equals\([ \t]*\"\"[ \t]*\)|\"\"\.equals\(", "Use isEmpty."),
    ("java/inefficient-string-constructor", _JV, "plain", r"\bnew[ \t]+String\([ \t]*(?:\"[^\"\n]*\")?[ \t]*\)", "Use the literal."),
    ("java/jdk-internal-api-access", _JV, "code", r"\b(?:sun\.misc|sun\.reflect|com\.sun\.proxy|jdk\.internal)\.[A-Z]\w*", "This may go away."),
    ("java/string-buffer-char-init", _JV, "plain", r"\bnew[ \t]+String(?:Buffer|Builder)\([ \t]*'(?:[^'\\]|\\.)'[ \t]*\)", "This is a size."),
    ("java/suspicious-date-format", _JV, "plain", r"\bnew[ \t]+SimpleDateFormat\([ \t]*\"[^\"\n]*YYYY[^\"\n]*M[^\"\n]*\"", "Y is the year of the week."),
    ("java/test-for-negative-container-size", _JV, "code", r"\.(?:size|length)(?:\(\))?[ \t]*(?:<[ \t]*0|>=[ \t]*0)(?![\w.])", "A size is never negative."),
    ("java/underscore-identifier", _JV, "code", r"(?<![\w.])_(?=[ \t]*[=;,)])", "This is a keyword."),
    ("java/useless-tostring-call", _JV, "plain", r"\"(?:[^\"\\\n]|\\.)*\"\.toString\(\)", "It is a string already."),
    ("java/constants-only-interface", _JV, "code", r"\binterface\s+\w+\s*\{(?:\s*(?:(?:public|static|final)\s+)*[\w<>\[\]]+\s+\w+\s*=[^;{}]*;)+\s*\}", "Use a class."),
)

#: Rules that give one finding on a whole file. Fixed names.
FILE_RULES = (("S2143", _JV, "code", r"(?m)^(?!\s*(?:import|package)\b)[^\n]*?\b(?:Date|Calendar|GregorianCalendar|Time)\b", "Use java.time."),)


def rule_keys(language: str | None = None) -> list[str]:
    return sorted({r[0] for r in (*RULES, *FILE_RULES) if language is None or language in r[1].split()})


def independent_keys() -> list[str]:
    """Keys of rules from other sources than the base catalog; their names tell."""
    return sorted({r[0] for r in RULES if not r[0].startswith("S") or r[0].startswith("SA")})


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pieces(text: str, language: str) -> str:
    """SQL: the text as an array of comments, literals and other runs."""
    cases = ""
    for name, (comments, literals) in LEXEMES.items():
        cases += f" when '{name}' then regexp_extract_all({text}, {_q('(?s)' + '|'.join((*comments, *literals)) + '|[A-Za-z0-9_ ]++|.')}, 0)"
    return f"case {language}{cases} else cast(array() as array<string>) end"


def _is(piece: str, language: str, part: int) -> str:
    """SQL: whether a piece is a comment (part 0) or a literal (part 1)."""
    if part == 0:
        return f"(left({piece}, 2) in ('//', '/*') and {language} not in ('ruby', 'python') or {language} = 'csharp' and length({piece}) > 1 and {piece} rlike '^[ \\\\t]*#' or {language} = 'ruby' and length({piece}) > 1 and left({piece}, 1) in ('#', '=') or {language} = 'python' and left({piece}, 1) = '#')"
    return f"(length({piece}) > 1 and {piece} rlike '^[^A-Za-z0-9_ ]|\"')"


def views(files: DataFrame) -> DataFrame:
    """path, language, text, code, plain, solid and comments of the files (path, language, text) in known languages."""
    f = files.where(F.col("language").isin(*LEXEMES)).select("path", "language", F.coalesce("text", F.lit("")).alias("text"))
    # what a piece is, is found out once for all views
    kind = f"case when length(p) > 1 or p = '#' then case when {_is('p', 'language', 0)} then 0 when {_is('p', 'language', 1)} then 1 else 2 end else 2 end"
    f = f.withColumn("pieces", F.expr(f"transform({_pieces('text', 'language')}, p -> named_struct('p', p, 'k', {kind}))"))
    blank = "regexp_replace(x.p, '[^\\n]', '{}')"
    hollow = "concat(left(x.p, 1), regexp_replace(substring(x.p, 2, length(x.p) - 2), '[^\\n]', ' '), right(x.p, 1))"

    def view(of_comment: str, of_literal: str, of_rest: str) -> Column:
        return F.expr(f"array_join(transform(pieces, x -> case x.k when 2 then {of_rest} when 0 then {of_comment} else {of_literal} end), '')")

    space = blank.format(" ")
    return f.select("path", "language", "text", view(space, hollow, "x.p").alias("code"), view(space, "x.p", "x.p").alias("plain"), view(blank.format("¤"), hollow, "x.p").alias("solid"), view("x.p", space, space).alias("comments"))


_OUT = "array<struct<rule_key:string,message:string,sl:int,sc:int,el:int,ec:int>>"


def _may(view: str, pattern: str) -> str:
    """SQL: a cheap test that goes before the pattern, where one is known."""
    word = needed(pattern)
    return f"contains({view}, {_q(word)}) and " if word else ""


#: A character for the ends of matches; texts that hold it are read with its neighbour in its place, which no rule tells from it.
_MARK, _OTHER = "\ue000", "\ue001"


def _matches(view: str, pattern: str, key: str, message: str) -> str:
    """SQL: a rule with the view where the ends of its matches are marked, or null. The pattern runs once."""
    marked = f"regexp_replace({view}, {_q(pattern)}, '{_MARK}$0{_MARK}')"
    found = f"transform(array({marked}), k -> if(contains(k, '{_MARK}'), named_struct('key', {_q(key)}, 'message', {_q(message)}, 'marked', k), null))[0]"
    return f"if({_may(view, pattern)}true, {found}, null)"


def _placed(rules: str) -> str:
    """SQL: the findings of an array of rules that matched, from the lines of their marked views."""
    far = running("sizes", "array<int>", "0", "acc + x", "acc + b", "acc + x", "int")
    near = "transform(sizes, (x, i) -> aggregate(slice(sizes, 1, i + 1), 0, (acc, y) -> acc + y))"
    # a mark's column is the size of what stands before it in its line
    columns = f"transform(array(transform(slice(p, 1, size(p) - 1), x -> length(x))), sizes -> if(size(sizes) > 32, {far}, {near}))[0]"
    on_line = f"transform(array(split(t, '{_MARK}', -1)), p -> transform({columns}, c -> named_struct('l', i + 1, 'c', c)))[0]"
    marks = f"flatten(transform(split(r.marked, '\n', -1), (t, i) -> if(contains(t, '{_MARK}'), {on_line}, cast(array() as array<struct<l:int,c:int>>))))"
    hit = "named_struct('rule_key', r.key, 'message', r.message, 'sl', m[2 * j].l, 'sc', m[2 * j].c, 'el', m[2 * j + 1].l, 'ec', m[2 * j + 1].c)"
    return f"flatten(transform(filter({rules}, r -> r is not null), r -> transform(array({marks}), m -> transform(sequence(0, cast(size(m) / 2 as int) - 1), j -> {hit}))[0]))"


def _on_file(view: str, pattern: str, key: str, message: str) -> str:
    """SQL: the finding of a rule on whole files, without a place."""
    zero = "'sl', 0, 'sc', 0, 'el', 0, 'ec', 0"
    return f"if({_may(view, pattern)}{view} rlike {_q(pattern)}, array(named_struct('rule_key', {_q(key)}, 'message', {_q(message)}, {zero})), cast(array() as {_OUT}))"


def with_origin(findings: DataFrame) -> DataFrame:
    """Findings with the origin of their rule, base or independent: one pass over the files has both."""
    return findings.withColumn("origin", F.when(F.col("rule_key").isin(sorted(independent_keys())), "independent").otherwise("base"))


def quality_findings(files: DataFrame, ids: set[str] | None = None) -> DataFrame:
    """Findings of the isolated code-quality profile; ids that aren't registered are an error."""
    unknown = (ids or set()) - {r[0] for r in QUALITY_RULES}
    if unknown:
        raise ValueError(f"not registered: {', '.join(sorted(unknown))}")
    return lexical_findings(files, ids, QUALITY_RULES, ())


def lexical_findings(files: DataFrame, keys: set[str] | None = None, rules: tuple = RULES, file_rules: tuple = FILE_RULES) -> DataFrame:
    """path, rule_key, message, sl, sc, el, ec (lines from 1, columns from 0) of all rules in one pass over the files."""
    wanted = lambda rules, name: [r for r in rules if name in r[1].split() and (keys is None or r[0] in keys)]
    on_places, on_files = "", ""
    for name in LEXEMES:
        parts = [_matches(view, pattern, key, message) for key, _, view, pattern, message in wanted(rules, name)]
        on_places += f" when '{name}' then array({', '.join(parts)})" if parts else ""
        parts = [_on_file(view, pattern, key, message) for key, _, view, pattern, message in wanted(file_rules, name)]
        on_files += f" when '{name}' then concat({', '.join(parts)})" if parts else ""
    hits = [_placed(f"case language{on_places} else array() end")] if on_places else []
    hits += [f"case language{on_files} else cast(array() as {_OUT}) end"] if on_files else []
    texts = files.withColumn("text", F.replace("text", F.lit(_MARK), F.lit(_OTHER)))
    out = views(texts).select("path", F.expr(f"concat({', '.join(hits)})" if hits else f"cast(array() as {_OUT})").alias("hits"))
    # The outer form keeps the optimizer from a filter on the array, which would work out every view anew for each rule.
    return out.select("path", F.explode_outer("hits").alias("h")).where("h is not null").select("path", "h.*")
