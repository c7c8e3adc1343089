"""Our own rule packs, as data: one for text corpora and one for web projects, with their dimensions.

Expressions use what Python, Java and RE2 read alike: no look-around, no back-references, no \\b, no \\w.
"""

from __future__ import annotations

from ..operators.rules import Rule
from .inventory import INVENTORY_RULES, KNOWLEDGE

TEXT_RULES = [
    Rule("secret.assigned-value", r"(?i)(password|passwd|token|secret|api[_-]?key)[ \t]*[=:][ \t]*[^ \t]+", "high", "high", techniques=("T1552", "T1552.001")),
    Rule("secret.aws-access-key", r"(AKIA|ASIA)[0-9A-Z]{16}", "critical", "high", techniques=("T1552",)),
    Rule("info-leak.mail-address", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "medium", "medium", techniques=("T1592",)),
    Rule("info-leak.host-address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "low", "medium", techniques=("T1592",)),
    Rule("license.notice", r"(?i)licen[cs]ed? under", "info", "low"),
]

WEB_RULES = [
    Rule("injection.eval", r"(^|[^.A-Za-z0-9_])eval\s*\(", "critical", "high", "code is evaluated from data", languages=("js", "jsx", "ts", "tsx"), techniques=("T1059.007",)),
    Rule("injection.command", r"(exec|execSync|spawn)\s*\(\s*`[^`]*\$\{", "critical", "high", "a shell command holds data", languages=("js", "ts"), techniques=("T1059",)),
    Rule("sqli.template-literal", r"(?i)(query|execute)\s*\(\s*`[^`]*(select|insert|update|delete)[^`]*\$\{", "critical", "high", "a query holds data", techniques=("T1190",)),
    Rule("xss.raw-html", r"dangerouslySetInnerHTML", "high", "medium", "raw HTML is set", languages=("jsx", "tsx", "js", "ts"), exclude_window=r"(?i)sanitize", techniques=("T1059.007",)),
    Rule("dom.inner-html", r"\.innerHTML\s*=[^=]", "high", "medium", "raw HTML is set", exclude_line=r"(?i)sanitize", techniques=("T1059.007",)),
    Rule("ssrf.fetch-template", r"fetch\s*\(\s*`\$\{", "high", "medium", "the host of a request comes from data", techniques=("T1190",)),
    Rule("cors.wildcard-credentials", r"(?i)access-control-allow-origin['\"]?\s*[,:]\s*['\"]\*", "high", "medium", "any origin is allowed", techniques=("T1557",)),
    Rule("csp.unsafe-inline", r"(?i)unsafe-inline", "medium", "medium", "inline scripts are allowed", techniques=("T1059.007",)),
    Rule("react.token-in-web-storage", r"(local|session)Storage\.setItem\s*\(\s*['\"][^'\"]*(token|jwt|auth)", "medium", "high", "a token is kept where scripts read it", techniques=("T1539",)),
    Rule("secret.generic", r"(?i)(api[_-]?key|secret|token|password)['\"]?\s*[:=]\s*['\"][A-Za-z0-9_\-]{12,}['\"]", "high", "medium", "a credential stands in the source", exclude_line=r"(?i)(example|placeholder|changeme|process\.env)", techniques=("T1552.001",)),
    Rule("crypto.weak-hash", r"createHash\s*\(\s*['\"](md5|sha1)['\"]", "medium", "high", "a weak hash", techniques=("T1600",)),
    Rule("tls.verification-off", r"(rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0)", "high", "high", "certificates aren't checked", techniques=("T1557",)),
    Rule("ai.prompt-from-request", r"(?i)(prompt|messages|content)\s*[:=]\s*`[^`]*\$\{[^}]*(req|request|params|query|body)", "high", "medium", "a prompt holds request data", techniques=("T1059",)),
    Rule("ai.endpoint-no-auth", r"export\s+async\s+function\s+POST\s*\([\s\S]{0,2000}?(openai|anthropic|completions)", "high", "medium", "a model endpoint without a check of who asks", requires_file=r"(?i)(openai|anthropic|completions)", exclude_line=r"(?i)(getServerSession|auth\(|verifyToken|clerk)", multiline=True, techniques=("T1190", "T1496")),
]

_JS = ("js", "jsx", "ts", "tsx", "mjs", "cjs")


def _web(rule_id: str, regex: str, severity: str, message: str, **more) -> Rule:
    return Rule(rule_id, regex, severity, more.pop("confidence", "medium"), message, languages=more.pop("languages", _JS), **more)


# Families of web projects, our own expressions: access, cookies and sessions, cryptography, hardening, injection, frameworks, model use.
FAMILY_RULES = [
    _web("auth.middleware-bypass", r"(?i)x-middleware-subrequest", "critical", "a header that skips the middleware is let through"),
    _web("auth.jwt-in-localstorage", r"(?i)localStorage\.setItem\s*\(\s*['\"](jwt|id_?token|access_?token)", "medium", "a token is kept where scripts read it"),
    _web("auth.hardcoded-credentials", r"(?i)(username|user)\s*===?\s*['\"][^'\"]+['\"]\s*&&\s*(password|pass|pwd)\s*===?\s*['\"]", "high", "a login is compared with fixed values"),
    _web("jwt.hardcoded-secret", r"jwt\.(sign|verify)\s*\([^,]+,\s*['\"][^'\"]+['\"]", "high", "the signing key stands in the source"),
    _web("jwt.alg-none", r"(?i)algorithms?['\"]?\s*[:=]\s*\[?[^\]]*['\"]none['\"]", "critical", "unsigned tokens are taken"),
    _web("jwt.decoded-not-verified", r"jwt\.decode\s*\(", "medium", "a token is read without a check of its signature", exclude_window=r"jwt\.verify", window=5),
    _web("session.hardcoded-secret", r"session\s*\(\s*\{[^}]*secret\s*:\s*['\"][^'\"]+['\"]", "high", "the session key stands in the source"),
    _web("cookie.insecure-flags", r"(?i)(httpOnly|secure)\s*:\s*false", "medium", "a cookie is open to scripts or plain connections", requires_file=r"(?i)cookie"),
    _web("crypto.hardcoded-key", r"create(Cipher|Decipher)(iv)?\s*\(\s*['\"][^'\"]+['\"]\s*,\s*['\"]", "high", "an encryption key stands in the source"),
    _web("crypto.weak-cipher", r"(?i)create(Cipher|Decipher)(iv)?\s*\(\s*['\"](des|rc4|aes-[0-9]+-ecb)", "medium", "a weak cipher"),
    _web("crypto.insecure-random", r"Math\.random\s*\(", "medium", "a guessable number where a secret is made", requires_line=r"(?i)(token|secret|password|session|nonce|otp)"),
    _web("crypto.hardcoded-iv", r"(?i)(^|[^a-z0-9_])(iv|salt)\s*[:=]\s*(Buffer\.from\s*\(\s*['\"]|['\"][^'\"]{8,}['\"])", "medium", "an initialisation vector or a salt that stays the same", exclude_line=r"process\.env"),
    _web("hardening.insecure-deserialization", r"(unserialize|yaml\.load|deserialize)\s*\(\s*(req|request|ctx)\b", "critical", "objects are built from data", exclude_line=r"(?i)safe_?load|JSON_SCHEMA"),
    _web("hardening.dev-only-branch-shipping-secret-bypass", r"NODE_ENV\s*!==?\s*['\"]production['\"]\s*\|\|", "medium", "a check is skipped outside production"),
    _web("hardening.source-map-shipped-to-prod", r"//#\s*sourceMappingURL=(https?:|/)", "low", "a source map is named in shipped code"),
    _web("injection.prototype-pollution-merge", r"(merge|mergeWith|extend|defaultsDeep|Object\.assign)\s*\([^)]*(req|request|ctx)\.(body|query)", "high", "data may change all objects"),
    _web("hardening.debug-enabled-in-prod", r"(?i)(^|[^a-z0-9_])(debug|verbose)\s*[:=]\s*true", "medium", "debug output is on", exclude_line=r"process\.env|NODE_ENV"),
    _web("nosqli.untrusted-query-filter", r"\.(find|findOne|findOneAndUpdate|updateOne|deleteOne|count|countDocuments)\s*\(\s*(req|request|ctx\.request)\.(body|query)", "high", "a query is made of request data"),
    _web("sqli.string-concatenation", r"(?i)['\"]\s*(select|insert|update|delete)\s[^'\"]*['\"]\s*\+", "critical", "a query is put together"),
    _web("injection.function-constructor", r"new\s+Function\s*\(\s*[^)'\"\s]", "critical", "code is made of data"),
    _web("injection.timer-string", r"set(Timeout|Interval)\s*\(\s*(['\"`][^'\"`]*\$\{|[A-Za-z_.]+\s*\+)", "high", "a timer evaluates text"),
    _web("injection.shell-option", r"(spawn|execFile)\s*\([^)]*shell\s*:\s*true", "high", "a shell reads the arguments"),
    _web("path-traversal.fs-read", r"path\.(join|resolve)\s*\([^)]*(req|request)\.(params|query|body)", "high", "a path is made of request data"),
    _web("ssrf.request-url", r"(fetch|axios(\.(get|post))?|got)\s*\(\s*(req|request)\.(query|body|params)", "high", "a request goes where data says"),
    _web("redirect.from-request", r"redirect\s*\(\s*(req|request)\.(query|body|params)", "medium", "visitors are sent where data says"),
    _web("xxe.entities-on", r"(?i)noent\s*:\s*true|resolveEntities\s*:\s*true", "high", "outside entities are read"),
    _web("dom.document-write", r"document\.write(ln)?\s*\(\s*[^'\"\s)]", "high", "data becomes markup"),
    _web("dom.insert-adjacent-html", r"insertAdjacentHTML\s*\([^,]+,\s*[^'\"\s]", "high", "data becomes markup"),
    _web("dom.message-any-origin", r"postMessage\s*\([^)]*,\s*['\"]\*['\"]", "medium", "a message goes to any page"),
    _web("react.ref-inner-html", r"\.current\.innerHTML\s*=", "high", "data becomes markup"),
    _web("react.javascript-url", r"(?i)href\s*=\s*\{?\s*['\"`]javascript:", "high", "a link runs code"),
    _web("react.href-user-value", r"href\s*=\s*\{\s*(props|user|params|query)\.[A-Za-z.]+\s*\}", "medium", "a link's target comes from data"),
    _web("react.unsanitized-markdown", r"(?i)(rehypeRaw|allowDangerousHtml|skipHtml\s*=\s*\{\s*false)", "medium", "markup in texts is kept", exclude_window=r"(?i)sanitize", window=8),
    _web("react.unsafe-target-blank", r"target\s*=\s*['\"]_blank['\"]", "low", "the opened page can steer this one", exclude_line=r"noopener|noreferrer"),
    _web("nextjs.image-dangerously-allow-svg", r"dangerouslyAllowSVG\s*:\s*true", "medium", "images may hold scripts"),
    _web("nextjs.api-wildcard-cors", r"(?i)setHeader\s*\(\s*['\"]access-control-allow-origin['\"]\s*,\s*['\"]\*", "medium", "any origin may read the answer", paths=("*pages/api/*", "*app/api/*")),
    _web("nextjs.api-env-exposure", r"\.json\s*\(\s*(process\.env\s*[,)]|\{[^}]*\.\.\.process\.env)", "critical", "the environment is sent out"),
    _web("nextjs.props-secret-leak", r"props\s*:\s*\{[^}]*process\.env\.(?:[A-Z_]*(SECRET|KEY|TOKEN|PASSWORD))", "high", "a secret goes to the page"),
    _web("nextjs.error-stack-leak", r"(?i)\.(json|send)\s*\([^)]*\b(err|error)\.stack", "low", "stack traces are sent out"),
    _web("nextjs.source-maps-exposed", r"productionBrowserSourceMaps\s*:\s*true", "low", "source maps are shipped"),
    _web("secret.public-env-exposure", r"NEXT_PUBLIC_[A-Z_]*(SECRET|PRIVATE|PASSWORD)", "high", "a secret is named public"),
    _web("vite.prod-sourcemap", r"sourcemap\s*:\s*(true|['\"]inline['\"])", "low", "source maps are shipped", requires_file=r"build\s*:"),
    _web("vite.define-inlines-secret", r"['\"]?[A-Za-z_.$]+['\"]?\s*:\s*(JSON\.stringify\s*\(\s*)?process\.env(\.[A-Z_]*(SECRET|KEY|TOKEN|PASSWORD)|\s*[,})])", "high", "a secret is put into the bundle", requires_file=r"define\s*:\s*\{"),
    _web("vite.import-meta-env-secret", r"import\.meta\.env\.VITE_[A-Z_]*(SECRET|TOKEN|PASSWORD)", "high", "a secret is read in the bundle"),
    _web("vite.dev-server-cors-wildcard", r"cors\s*:\s*(true|\{[^}]*origin\s*:\s*(true|['\"]\*))", "medium", "the development server answers any origin", requires_file=r"server\s*:"),
    _web("vite.fs-strict-disabled", r"strict\s*:\s*false", "medium", "the development server gives out any file", requires_file=r"fs\s*:\s*\{"),
    _web("csp.unsafe-eval", r"(?i)script-src[^;'\"]*'unsafe-eval'", "medium", "evaluated code is allowed"),
    _web("csp.disabled-in-helmet", r"contentSecurityPolicy\s*:\s*false", "medium", "the policy is turned off"),
    _web("cors.origin-reflection", r"(?i)access-control-allow-origin['\"]\s*,\s*(req|request)\.headers", "high", "the asking origin is let in"),
    _web("cors.wildcard-with-credentials", r"cors\s*\(\s*\{[^}]*origin\s*:\s*(true|['\"]\*['\"])[^}]*credentials\s*:\s*true", "high", "any origin is allowed, with cookies"),
    _web("cors.permissive-middleware", r"app\.use\s*\(\s*cors\s*\(\s*\)\s*\)", "low", "any origin is allowed"),
    _web("ai.llm-output-rendered-as-html", r"dangerouslySetInnerHTML\s*=\s*\{\{\s*__html\s*:\s*(completion|answer|reply|message\.content)", "high", "a model's text becomes markup"),
    _web("ai.llm-output-to-sink", r"(eval|exec|execSync)\s*\(\s*(completion|answer|reply|response\.text)", "critical", "a model's text is run"),
    _web("ai.dangerously-allow-browser", r"dangerouslyAllowBrowser\s*:\s*true", "high", "the model's key goes to the browser"),
    _web("ai.prompt-injection", r"role\s*:\s*['\"]system['\"]\s*,\s*content\s*:\s*(req|request)\.", "high", "the instructions come from data"),
    _web("ai.unbounded-output", r"chat\.completions\.create\s*\(\s*\{", "low", "an answer may be of any length", exclude_window=r"max_(completion_)?tokens", window=8, confidence="low"),
]
WEB_RULES = [*WEB_RULES, *FAMILY_RULES, *INVENTORY_RULES]

#: The first entry of each rule.
PACK = {r.rule_id: r for r in reversed([*TEXT_RULES, *WEB_RULES])}

#: rule_id, title, severity, why, fix, cwe.
DIMENSION = [
    ("secret.assigned-value", "Assigned secret", "high", "a value that grants access stands in text", "rotate it and keep it out of text", "CWE-798"),
    ("secret.aws-access-key", "Cloud access key id", "critical", "a cloud key id stands in text", "rotate the key", "CWE-798"),
    ("info-leak.mail-address", "Mail address", "medium", "personal data", "mask it", "CWE-200"),
    ("info-leak.host-address", "Host address", "low", "internal topology", "mask it", "CWE-200"),
    ("injection.eval", "Evaluated code", "critical", "data becomes code", "parse instead", "CWE-95"),
    ("injection.command", "Shell command from data", "critical", "data becomes a command", "pass arguments as a list", "CWE-78"),
    ("sqli.template-literal", "Query from data", "critical", "data becomes a query", "bind parameters", "CWE-89"),
    ("xss.raw-html", "Raw HTML", "high", "data becomes markup", "sanitize or render as text", "CWE-79"),
    ("dom.inner-html", "Raw HTML", "high", "data becomes markup", "set text instead", "CWE-79"),
    ("sqli.tainted-query", "Query from data", "critical", "data from outside becomes a query", "bind parameters", "CWE-89"),
    ("ssrf.fetch", "Request to a host from data", "high", "data from outside says where a request goes", "allow known hosts only", "CWE-918"),
    ("open-redirect", "Redirect from data", "medium", "visitors are sent where data says", "redirect to paths of your own", "CWE-601"),
    ("xss.inner-html", "Raw HTML from data", "high", "data becomes markup", "set text instead", "CWE-79"),
    ("xss.dangerously-set-inner-html", "Raw HTML from data", "high", "data becomes markup", "sanitize or render as text", "CWE-79"),
    ("dataflow.sensitive-to-log", "Secret in a log", "high", "a secret is kept where many can read", "log that it is there, not what it is", "CWE-532"),
    ("dataflow.sensitive-to-response", "Secret in a response", "high", "a secret is sent to a client", "send only what the client needs", "CWE-200"),
    ("dataflow.sensitive-to-browser-storage", "Secret in browser storage", "high", "any script of the page can read it", "use a cookie that scripts can't read", "CWE-922"),
    ("dataflow.sensitive-to-thirdparty", "Secret sent to others", "high", "a secret goes to a service of others", "leave it out of what is sent", "CWE-201"),
    ("ai.excessive-agency-command", "A tool runs commands", "critical", "what a model says becomes a command", "offer fixed commands only", "CWE-78"),
    ("ai.excessive-agency-code", "A tool runs code", "critical", "what a model says becomes code", "parse instead", "CWE-95"),
    ("ai.excessive-agency-filesystem", "A tool writes files", "high", "what a model says chooses files", "keep to one folder and fixed names", "CWE-22"),
    ("ai.excessive-agency-sql", "A tool runs raw queries", "critical", "what a model says becomes a query", "bind parameters", "CWE-89"),
    ("ai.tool-ssrf", "A tool requests any host", "high", "what a model says chooses hosts", "allow known hosts only", "CWE-918"),
    ("ai.improper-output-handling", "Output of a model is run", "critical", "what a model says is run", "treat it as data", "CWE-94"),
    ("ai.prompt-injection-to-agency", "Untrusted prompt with a dangerous tool", "critical", "content of others can steer the tool", "separate such content, or take the tool away", "CWE-94"),
    ("deps.known-vulnerability", "Known vulnerability", "high", "an advisory covers the version", "upgrade", "CWE-1395"),
    ("deps.typosquat", "Name like a popular one", "high", "it may have been installed by mistake", "check the name", "CWE-427"),
    ("supply-chain.dependency-install-script", "Dangerous install script", "critical", "a package runs it when installed", "take the package out", "CWE-506"),
    ("supply-chain.dependency-script-changed", "Changed install script", "critical", "a package runs something new when installed", "read what has changed", "CWE-506"),
    ("supply-chain.integrity-changed", "Changed package content", "critical", "the same version has other content", "find out why", "CWE-494"),
    ("supply-chain.missing-integrity", "Package without a digest", "medium", "its content can't be checked", "write the lockfile anew", "CWE-353"),
    ("hardening.env-committed", "Environment file in the repository", "critical", "secrets are in its history", "take it out and rotate", "CWE-538"),
    ("hardening.env-not-gitignored", "Environment file not ignored", "high", "it will be committed some day", "ignore it", "CWE-538"),
    ("config.missing-security-headers", "No security headers", "medium", "browsers aren't told what to refuse", "set them", "CWE-693"),
    ("config.disabled-tls-verification", "Certificate checks off", "high", "connections can be read", "trust the certificate instead", "CWE-295"),
    ("tls.verification-off", "Certificate checks off", "high", "connections can be read", "trust the certificate instead", "CWE-295"),
]

DIMENSION += [k[:6] for k in KNOWLEDGE]

# Techniques of rules that aren't patterns.
RULE_TECHNIQUES = {
    "sqli.tainted-query": ("T1190",), "ssrf.fetch": ("T1190",), "open-redirect": ("T1204.001",), "xss.inner-html": ("T1059.007",), "xss.dangerously-set-inner-html": ("T1059.007",), "dataflow.sensitive-to-log": ("T1552.001",), "dataflow.sensitive-to-response": ("T1552",),
    "dataflow.sensitive-to-browser-storage": ("T1552",), "dataflow.sensitive-to-thirdparty": ("T1567",), "ai.excessive-agency-command": ("T1059",), "ai.excessive-agency-code": ("T1059.007",), "ai.excessive-agency-filesystem": ("T1190",), "ai.excessive-agency-sql": ("T1190",),
    "ai.tool-ssrf": ("T1190",), "ai.improper-output-handling": ("T1059.007",), "ai.prompt-injection-to-agency": ("T1059.007", "T1190"), "deps.known-vulnerability": ("T1195.001",), "deps.typosquat": ("T1195.002",), "supply-chain.dependency-install-script": ("T1195.002",),
    "supply-chain.dependency-script-changed": ("T1195.002",), "supply-chain.integrity-changed": ("T1195.002",), "supply-chain.missing-integrity": ("T1195.001",), "hardening.env-committed": ("T1552.001",), "hardening.env-not-gitignored": ("T1552.001",),
    "config.missing-security-headers": ("T1190", "T1185"), "config.disabled-tls-verification": ("T1557",),
}

RULE_TECHNIQUES |= {k[0]: k[6] for k in KNOWLEDGE}

#: A rule's own techniques, else those of the list.
BRIDGE = [*[(r.rule_id, t) for r in PACK.values() for t in r.techniques], *[(r, t) for r, ts in RULE_TECHNIQUES.items() if r not in PACK or not PACK[r].techniques for t in ts]]

# Technique, tactic.
TECHNIQUES = [
    ("T1059", "Execution"), ("T1059.007", "Execution"), ("T1078", "Defense Evasion"), ("T1083", "Discovery"), ("T1185", "Collection"), ("T1190", "Initial Access"), ("T1195.001", "Initial Access"), ("T1195.002", "Initial Access"), ("T1204.001", "Execution"), ("T1496", "Impact"),
    ("T1499", "Impact"), ("T1539", "Credential Access"), ("T1552", "Credential Access"), ("T1552.001", "Credential Access"), ("T1557", "Credential Access"), ("T1567", "Exfiltration"), ("T1592", "Reconnaissance"), ("T1600", "Defense Evasion"), ("T1606.001", "Credential Access"),
]


def dimension(spark):
    return spark.createDataFrame(DIMENSION, "rule_id string, title string, severity string, why string, fix string, cwe string")


def bridge(spark):
    return spark.createDataFrame(BRIDGE, "rule_id string, technique_id string")


def techniques(spark):
    return spark.createDataFrame(TECHNIQUES, "technique_id string, tactic string")
