"""Declarative rules over columns: weakness numbers, kinds of endpoints, severity, confidence, binary metrics."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of weakness in the order in which their words are looked for, with number and base severity.
KINDS = (
    ("deserialization", 502, "CRITICAL", "deserialize|deserialization|readobject|readvalue|objectinputstream|xmldecoder"),
    ("code_injection", 94, "CRITICAL", "code_injection|code injection|el_injection|expression_language|classforname|class_loading|arbitrary_class|reflection|reflective|scriptengine|groovyshell"),
    ("xss", 79, "MEDIUM", "xss|cross-site|html|script|output"),
    ("command_injection", 78, "CRITICAL", "command|exec|process|runtime|shell"),
    ("path_traversal", 22, "HIGH", "path|traversal|file|directory"),
    ("xxe", 611, "HIGH", "xxe|xml|entity"),
    ("open_redirect", 601, "MEDIUM", "open_redirect|open redirect|redirect|sendredirect"),
    ("ssrf", 918, "HIGH", "ssrf|url|http_client|request_forgery"),
    ("sql_injection", 89, "CRITICAL", "sql|query|database|jdbc"),
)
# What the snippet of a source shows about it, first match wins.
SOURCE_KINDS = (
    (
        "user_input",
        r"getParameter\(|getHeader\(|getCookies\(|getInputStream\(|getQueryString\("
        r"|@RequestParam|@PathVariable|@RequestBody|@CookieValue|@RequestHeader"
        r"|@QueryParam|@FormParam|@HeaderParam|@PathParam|@MatrixParam"
        r"|getFormParameters\(|getDecodedFormParameters\("
        r"|getReader\(|getRemoteUser\(|getRemoteAddr\(",
    ),
    ("external_data", r"FileReader\(|readLine\(|readAllBytes\(|InputStream|deserialize\(|readObject\(|Scanner\(|BufferedReader\(|\.readValue\("),
    ("session_data", r"getSession\(|getAttribute\(|getNote\(|getClaim\(|getAuthenticatedUser\(|getPrincipal\(|getCredentials\(|session\.get"),
    ("database", r"ResultSet|getString\(|getInt\(|getObject\(|findBy|getOne\(|findAll\("),
)
# What the snippet of a sink shows about it, first match wins.
SINK_KINDS = (
    (
        "direct_execution",
        r"execute\(|executeQuery\(|executeUpdate\(|exec\(|ProcessBuilder|Runtime\.getRuntime\(|createQuery\(|createNativeQuery\(|nativeQuery\("
        r"|Class\.forName\(|classForName\(|ScriptEngine|GroovyShell|Method\.invoke\(",
    ),
    (
        "event_logging",
        r"\b(LOG|LOGGER|log|logger)\s*\.\s*(info|warn|debug|error|trace|fatal)\("
        r"|\b(?:listener\.)?getLogger\(\)\s*\.\s*(?:print|println|printf)\(|\blistener\s*\.\s*fatalError\("
        r"|\b(slf4j|Slf4j|SLF4J)\b|\bMDC\.(put|get)\(|\bAudit(Event|Log|Logger)\b",
    ),
    (
        "output_rendering",
        r"\.write\(|println\(|print\(|sendRedirect\(|getWriter\(|addAttribute\(|forward\(|include\(|sendError\("
        r"|renderResponse\(|renderTemplate\(|Response\.ok\(|ResponseEntity\.ok\(",
    ),
    ("resource_access", r"FileOutputStream\(|FileWriter\(|new URL\(|openConnection\(|HttpClient|HttpURLConnection|new File\(|Paths\.get\(|DocumentBuilder|SAXParser|XMLReader"),
    (
        "benign",
        r"\bBase64(Url|Utils)?\.(encode|encodeBytes|encodeToString)\(|\bHex\.encode(Hex|String)?\(|\bStringBuilder\b\s*\(\s*\)?|sb\.append\(|String\.format\(|\.toString\(\)\s*$",
    ),
    ("data_storage", r"setAttribute\(|persist\(|save\(|merge\(|insert\(|update\(|put\("),
    ("framework_api", r"new\s+\w+\(|set[A-Z]\w+\("),
)
# What the kind of a weakness says about a sink of which the snippet says nothing.
SINK_OF_KIND = (
    ("direct_execution", ("sql_injection", "command_injection", "code_injection", "deserialization")),
    ("output_rendering", ("xss", "open_redirect")),
    ("resource_access", ("path_traversal", "ssrf", "xxe")),
)
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def first_match(text: Column, rules, otherwise: Column) -> Column:
    """The name of the first rule (name, pattern) that the text matches."""
    return F.coalesce(*[F.when(text.rlike(pattern), name) for name, pattern in rules], otherwise)


def weakness_number(text: Column) -> Column:
    """CWE-n of a number with an optional prefix and leading zeros; null when the text is none."""
    digits = F.nullif(F.regexp_extract(F.trim(text), r"^(?:[Cc][Ww][Ee][-_ ]?)?0*([0-9]+)$", 1), F.lit(""))
    return F.concat(F.lit("CWE-"), digits)


def weakness_kind(label: Column) -> Column:
    """The kind of weakness that a free label means: a kind's own name, else the first kind whose words it holds."""
    low = F.lower(F.trim(label))
    exact = F.when(low.isin(*[k for k, *_ in KINDS]), low)
    return F.coalesce(exact, first_match(low, [(k, p) for k, _, _, p in KINDS], F.lit("other")))


def weakness_of(kind: Column, otherwise: Column) -> Column:
    """CWE-n of a kind."""
    return F.coalesce(*[F.when(kind == k, f"CWE-{n}") for k, n, *_ in KINDS], otherwise)


def severity(kind: Column, confidence: Column, sanitizers: Column) -> Column:
    """Base severity of the kind, one level lower below 0.6 of confidence and, from HIGH on, with sanitizers."""
    base = F.coalesce(*[F.when(kind == k, LEVELS.index(s)) for k, _, s, _ in KINDS], F.lit(1))
    unsure = F.greatest(F.lit(0), base - F.when(confidence < 0.6, 1).otherwise(0))
    level = unsure - F.when((sanitizers > 0) & (unsure >= 2), 1).otherwise(0)
    return F.element_at(F.array(*map(F.lit, LEVELS)), (level + 1).cast("int"))


def adjusted_confidence(confidence: Column, source_kind: Column, sink_kind: Column) -> Column:
    """A tenth for harmless sinks, three tenths for storage of internal data, else as it is."""
    inner = source_kind.isin("session_data", "internal_api", "database")
    return confidence * F.when(sink_kind.isin("benign", "event_logging"), 0.1).when(sink_kind.isin("data_storage", "framework_api") & inner, 0.3).otherwise(1.0)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded, 0 for an empty whole."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), digits)


def f1(tp: Column, fp: Column, fn: Column, digits: int = 4) -> Column:
    """Harmonic mean of precision and recall, from the counts."""
    return ratio(2 * tp, 2 * tp + fp + fn, digits)


def unit_confidence(c: Column) -> Column:
    """A confidence on the scale 0 to 1: null and NaN are unknown, percentages are divided."""
    known = F.when(~F.isnan(c), c)
    return F.when(known > 1, F.least(known / 100, F.lit(1.0))).when(known < 0, 0.0).otherwise(known)
