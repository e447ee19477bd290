"""Java-like source text to rows: lines, comments, variables, data flows, functions, imports, endpoints.

All of it is regular expressions inside Spark, so it stays in generated code and never passes through Python. A text
is one row (file, text); results carry the file and, where they stand on a line, line_number from 1.

Defined results: null texts give no rows, an empty text is one empty line; line ends are \\n, a \\r before it belongs to
the line; rows that repeat give their results again, but equal rows get their function once (in_functions); an empty
table gives none.
"""

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of the language that are no variables.
KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while true false null var String Object List"
).split()
NAME = "[A-Za-z_][A-Za-z0-9_]*"
WORD = r"[\p{L}\p{N}_]+"
STATEMENT = rf"^\s*(?:(?:final|static|private|protected|public)\s+)*(?:[A-Za-z_][A-Za-z0-9_.<>\[\], ]*\s+)?(?:this\.)?({NAME})\s*=\s*([^=].*?);?\s*$"
CALL = rf"({NAME})\.({NAME})\(([^()]*)\)"
FUNCTION = rf"^\s*(?:(?:public|private|protected|static|final)\s+)+(?:[A-Za-z_][A-Za-z0-9_.<>\[\], ]*\s+)?({NAME})\(([^()]*)\)\s*(?:throws [A-Za-z_., ]+)?\{{"
IMPORT = r"^\s*import\s+(?:static\s+)?([A-Za-z0-9_.*]+)\s*;"
CLASS = rf"\bclass\s+({NAME})(?:\s+extends\s+({NAME}))?"
TOKEN = r"""(?s)"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*.*?\*/|[^"'/]+|."""
# The same with possessive literals, as Java's stack grows with each repetition of a group that it may go back into. No
# part of a literal can be its end, so going back finds nothing.
TOKEN_JAVA = TOKEN.replace(')*"', ')*+"').replace(")*'", ")*+'")
# A call with names that are not gone back into, as neither can hold its end.
CALL_JAVA = CALL.replace("]*)", "]*+)", 2)
# Words; group 1 holds those that are identifiers of several letters and no keyword, for names_in.
IDENTIFIER = rf"(?!(?:{'|'.join(KEYWORDS)})(?![\p{{L}}\p{{N}}_]))([A-Za-z_][A-Za-z0-9_]++)(?![\p{{L}}\p{{N}}_])|[\p{{L}}\p{{N}}_]++"
#: Stands before and between the parts of a statement; no statement begins with it.
MARK = "\x01"
# Words that the reference's flow patterns take for no variables, and the patterns, with word and space as there.
FLOW_KEYWORDS = (
    "public private protected static final class interface void int String boolean double float long short byte char if else for while return new "
    "null true false this super import package try catch finally throw throws List Map Set"
).split()
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
FLOWS = {
    "assignment": rf"([a-zA-Z_][\p{{L}}\p{{N}}_]*){SPACE}*=({SPACE}*[^;=]+);",
    "method_chain": rf"({WORD})\.([a-zA-Z_]{WORD}){SPACE}*\(",
    "throw_arg": rf"throw{SPACE}+new{SPACE}+({WORD}){SPACE}*\(([^\n]+?)\){SPACE}*;",
    "return": rf"return{SPACE}+([^;]+);",
    "method_arg": rf"({WORD})\.{WORD}{SPACE}*\(([^)]+)\)",
}
# Calls that bring in untrusted data, and calls that may do harm with it, by kind.
INPUT_CALLS = "getParameter|getHeader|getQueryString|getCookieValue|getInputStream|getReader|readLine|body|next|fetch|load"
SINKS = (
    ("sql_injection", "executeQuery|executeUpdate|createQuery|createNativeQuery"),
    ("command_injection", "exec"),
    ("code_injection", "eval|forName|loadClass"),
    ("deserialization", "readObject|readValue|deserialize"),
    ("open_redirect", "sendRedirect|redirect|forward"),
    ("xss", "print|println|write|append"),
    ("path_traversal", "open|delete"),
)
# Sanitizers: type, what it protects from, effectiveness, pattern.
_ALL = "sql_injection,xss,command_injection,path_traversal"
SANITIZERS = (
    ("prepared_statement", "sql_injection", 1.0, r"(?i)\.prepareStatement\s*\("),
    ("parameterized_query", "sql_injection", 1.0, r"\.\s*set(String|Int|Long|Float|Double|Object|Boolean)\s*\("),
    ("jpa_parameter", "sql_injection", 0.95, r"\.setParameter\s*\(|\.createNamedQuery\s*\("),
    ("jdbc_template_param", "sql_injection", 0.9, r"NamedParameterJdbcTemplate|jdbcTemplate\.query(ForObject|ForList)?\s*\(\s*[^,]+,\s*\w+,"),
    ("html_escape", "xss", 0.95, r"HtmlUtils\s*\.\s*htmlEscape\s*\("),
    ("html_escape", "xss", 0.95, r"StringEscapeUtils\s*\.\s*escape(Html3?|Html4?|Xml(10|11)?|EcmaScript|Java(Script)?|Csv)\s*\("),
    ("esapi_encode", "xss", 0.95, r"ESAPI\s*\.\s*encoder\s*\(\s*\)\s*\.\s*encode\w*\s*\("),
    ("jsoup_clean", "xss", 0.9, r"\bJsoup\s*\.\s*clean\s*\("),
    ("html_escape", "xss", 0.9, r"HtmlUtils\s*\.\s*htmlEscape(Decimal|Hex)?\s*\("),
    ("path_normalization", "path_traversal", 0.5, r"\.normalize\s*\(\s*\)"),
    ("path_prefix_check", "path_traversal", 0.5, r"\.startsWith\s*\("),
    ("path_traversal_check", "path_traversal", 0.9, r'\.contains\s*\(\s*"\.\."\s*\)'),
    ("path_segment_removal", "path_traversal", 0.9, r'\.replace\s*\(\s*"\.\./"\s*,\s*""\s*\)'),
    ("canonical_path", "path_traversal", 0.5, r"\.getCanonical(Path|File)\s*\("),
    ("process_builder_args", "command_injection", 0.9, r'new\s+ProcessBuilder\s*\(\s*"[^"]*"\s*,'),
    ("process_builder_list", "command_injection", 0.9, r"new\s+ProcessBuilder\s*\(\s*(Arrays\.asList|List\.of|new\s+ArrayList)"),
    ("exec_string_array", "command_injection", 0.9, r"\.exec\s*\(\s*new\s+String\s*\["),
    ("string_array_command", "command_injection", 0.9, r"String\s*\[\s*\]\s+\w+\s*=\s*\{"),
    ("regex_validation", _ALL, 0.9, r'\.matches\s*\(\s*"[^"]*"'),
    ("pattern_matcher_validation", _ALL, 0.9, r"Pattern\s*\.\s*compile\s*\([^)]+\)\.matcher\s*\([^)]+\)\s*\.\s*matches\s*\("),
    ("bean_validation", _ALL, 0.85, r"javax\.validation\.|jakarta\.validation\.|@Valid\b|Validator\s*\.\s*validate\s*\("),
    ("numeric_parse", "sql_injection,command_injection", 0.9, r"(Integer\.parseInt|Long\.parseLong|Double\.parseDouble)\s*\("),
    ("uuid_validation", "sql_injection,command_injection,path_traversal", 0.9, r"UUID\s*\.\s*fromString\s*\("),
)
# What makes a file worth a look.
RELEVANT = (
    r"getParameter|getHeader|getCookies|getInputStream|getReader|getQueryString"
    r"|@RequestParam|@PathVariable|@RequestBody|@RequestHeader|@CookieValue"
    r"|HttpServletRequest|HttpServletResponse"
    r"|executeQuery|executeUpdate|prepareStatement|createStatement|execute\("
    r"|createNativeQuery|createQuery"
    r"|Runtime\.getRuntime|ProcessBuilder|exec\("
    r"|setAttribute|getRequestDispatcher|sendRedirect|addCookie|\.write\("
    r"|innerHTML|document\.write|\.html\("
    r"|new\s+File\(|new\s+FileInputStream|Paths\.get|Files\."
    r"|DocumentBuilder|SAXParser|XMLReader|TransformerFactory"
    r"|URL\(|HttpURLConnection|HttpClient|openConnection"
    r"|ObjectInputStream|readObject|XMLDecoder"
    r"|DirContext|InitialDirContext|search\("
)
#: Lines of a band in which lines and functions are joined; this changes the cost only.
BAND = 16
SECRET = r"(?i)\b(password|passwd|secret|token|api_?key)(\s*[=:]\s*)[^\s,;]+"


def has(line: Column, pattern: str) -> Column:
    """Whether a line has the pattern; lines without the letters that each of its branches needs are told by these alone,
    at a fraction of the cost."""
    needed = letters(pattern)
    return functools.reduce(operator.or_, [line.contains(x) for x in needed]) & line.rlike(pattern) if needed else line.rlike(pattern)


def letters(pattern: str) -> list[str]:
    """For each branch of a pattern the longest run of letters outside of groups and classes, which its matches all have;
    none if a branch has no such run of three or case doesn't count."""
    if pattern.startswith("(?i)"):
        return []
    plain = re.sub(r"\[[^\]]*\]", " ", re.sub(r"\\.", " ", pattern))
    while (less := re.sub(r"\([^()]*\)", " ", plain)) != plain:
        plain = less
    runs = [re.findall(r"[A-Za-z]{3,}(?![A-Za-z?*{])", branch) for branch in plain.split("|")]
    return [max(r, key=len) for r in runs] if all(runs) else []


def lines(files: DataFrame) -> DataFrame:
    """(file, line_number, line)."""
    rows = files.where("text is not null").select("file", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.select("file", (F.col("at") + 1).alias("line_number"), "line")


def without_comments(text: Column) -> Column:
    """The text with each comment replaced by as many line ends as it held; literals keep theirs."""
    blank = lambda t: F.repeat(F.lit("\n"), F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN_JAVA), F.lit(0)), lambda t: F.when(t.startswith("//") | t.startswith("/*"), blank(t)).otherwise(t)), "")


def names_in(text: Column) -> Column:
    """The distinct variables of a text: identifiers that are no keyword and longer than a letter."""
    return F.array_distinct(F.array_remove(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(1)), ""))


def variables(files: DataFrame) -> DataFrame:
    """(file, variable)."""
    return files.where("text is not null").select("file", F.explode(names_in(F.col("text"))).alias("variable"))


def flow_type(value: Column) -> Column:
    """How a value comes from its parts."""
    return (
        F.when(value.rlike(rf"^{NAME}$"), "direct").when(value.contains('"') & value.contains("+"), "concatenation")
        .when(value.rlike(r"[-+*/%]"), "arithmetic").when(value.contains("("), "method_call").otherwise("other")
    )


def assignments(files: DataFrame) -> DataFrame:
    """(file, line_number, from_var, to_var, flow_type): each variable on the right of an assignment flows to the left."""
    # One match gives both sides of a statement; a line that is none has no value, of which no row is made.
    part = F.split(F.regexp_replace("line", STATEMENT, f"{MARK}$1{MARK}$2"), MARK, 3)
    rows = lines(files).where(F.col("line").contains("=") & ~F.col("line").startswith(MARK)).select("file", "line_number", part.alias("part"))
    value = F.when(F.col("part")[0] == "", F.try_element_at("part", F.lit(3)))
    rows = rows.select("file", "line_number", F.explode(names_in(F.regexp_replace(value, r'"[^"]*"', '""'))).alias("from_var"), "part")
    return rows.select("file", "line_number", "from_var", F.col("part")[1].alias("to_var"), flow_type(F.col("part")[2]).alias("flow_type")).where("from_var <> to_var")


def calls(files: DataFrame) -> DataFrame:
    """(file, line_number, receiver, method, arguments): calls by line, arguments as written."""
    rows = lines(files).where(F.col("line").contains("(") & F.col("line").contains("."))
    rows = rows.select("file", "line_number", F.explode(F.regexp_extract_all("line", F.lit(CALL_JAVA), F.lit(0))).alias("call"))
    # Names hold no point and no parenthesis, so the first of each divides the call.
    name, upto = F.substring_index("call", "(", 1), F.length(F.substring_index("call", "(", 1))
    arguments = F.substring(F.col("call"), upto + 2, F.length("call") - upto - 2)
    return rows.select("file", "line_number", F.substring_index("call", ".", 1).alias("receiver"), F.substring_index(name, ".", -1).alias("method"), arguments.alias("arguments"))


def argument_flows(files: DataFrame) -> DataFrame:
    """(file, line_number, from_var, to_var, flow_type): variables in the arguments of a call flow to its receiver."""
    rows = calls(files).select("file", "line_number", F.explode(names_in(F.regexp_replace("arguments", r'"[^"]*"', '""'))).alias("from_var"), F.col("receiver").alias("to_var"))
    return rows.where("from_var <> to_var").withColumn("flow_type", F.lit("method_arg"))


def call_ends(files: DataFrame) -> DataFrame:
    """(file, line_number, from_var, to_var, vuln_type): argument_flows (without a kind) and static_sinks (without a target)
    of one reading of the calls."""
    rows = calls(files).select("file", "line_number", "receiver", _harm("method").alias("kind"), names_in(F.regexp_replace("arguments", r'"[^"]*"', '""')).alias("names"))
    row = lambda a, b, c: F.struct(a.alias("from_var"), b.cast("string").alias("to_var"), c.cast("string").alias("vuln_type"))
    flows = F.transform(F.filter("names", lambda x: x != F.col("receiver")), lambda x: row(x, F.col("receiver"), F.lit(None)))
    harmful = F.col("kind").isNotNull() & (F.size("names") > 0)
    sink = F.slice(F.array(row(F.try_element_at("names", F.lit(1)), F.lit(None), F.col("kind"))), F.lit(1), harmful.cast("int"))
    return rows.select("file", "line_number", F.explode(F.concat(flows, sink)).alias("x")).select("file", "line_number", "x.*")


def flow_words(text: Column) -> Column:
    """The words of a text that the flow patterns take for variables, as often as they stand there."""
    plain = lambda x: (F.length(x) > 1) & x.rlike("^[a-zA-Z_]") & ~x.isin(FLOW_KEYWORDS)
    return F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), plain)


def pattern_flows(files: DataFrame) -> DataFrame:
    """(file, line_number, from_var, to_var, flow_type): the flows of the reference's five patterns, every match on a
    line and every word of it giving a row, so that rows may repeat. Text in quotes and remarks counts too."""
    part = lambda t, i: F.regexp_extract_all("line", F.lit(FLOWS[t]), F.lit(i))
    matches = lambda t, names, target: F.transform(F.arrays_zip(part(t, names).alias("names"), target.alias("target")), lambda x: F.struct(F.lit(t).alias("type"), x["names"].alias("names"), x["target"].alias("target")))
    found = F.concat(
        matches("assignment", 2, part("assignment", 1)), matches("method_chain", 1, part("method_chain", 2)), matches("throw_arg", 2, part("throw_arg", 1)),
        matches("return", 1, F.transform(part("return", 1), lambda _: F.lit("return_value"))), matches("method_arg", 2, part("method_arg", 1)),
    )
    rows = lines(files).select("file", "line_number", F.explode(found).alias("x"))
    rows = rows.select("file", "line_number", F.explode(flow_words(F.col("x.names"))).alias("from_var"), F.col("x.target").alias("to_var"), F.col("x.type").alias("flow_type"))
    other = F.col("from_var") != F.col("to_var")
    named = (F.length("to_var") > 1) & ~F.col("to_var").isin(FLOW_KEYWORDS)
    return rows.where(F.when(F.col("flow_type") == "assignment", other).when(F.col("flow_type") == "method_arg", other & named).when(F.col("flow_type") == "method_chain", named).otherwise(True))


def heads(files: DataFrame) -> DataFrame:
    """(file, function_name, parameters, start_line): functions by the pattern of their header alone."""
    rows = lines(files).where(F.col("line").contains("{") & F.col("line").contains("(") & F.col("line").rlike(FUNCTION))
    return rows.select("file", F.regexp_extract("line", FUNCTION, 1).alias("function_name"), F.trim(F.regexp_extract("line", FUNCTION, 2)).alias("parameters"), F.col("line_number").alias("start_line"))


def functions(files: DataFrame) -> DataFrame:
    """(file, function_name, parameters, start_line, end_line): headers by pattern, ends where the braces close.

    The depth of braces is a running sum over the lines of one file; a function ends at the first later line where the
    depth is back at that before its header, or at the last line. Lines without braces leave the depth as it is, so only
    lines with braces are shuffled and sorted.
    """
    delta = F.length(F.regexp_replace("line", r"[^{]", "")) - F.length(F.regexp_replace("line", r"[^}]", ""))
    upto = F.sum("delta").over(Window.partitionBy("file").orderBy("line_number"))
    is_head = F.col("line").contains("{") & F.col("line").contains("(") & F.col("line").rlike(FUNCTION)
    head = F.when(is_head, F.struct(F.regexp_extract("line", FUNCTION, 1).alias("function_name"), F.trim(F.regexp_extract("line", FUNCTION, 2)).alias("parameters"))).alias("head")
    braces = lines(files).where(F.col("line").contains("{") | F.col("line").contains("}")).select("file", "line_number", delta.alias("delta"), head)
    depth = braces.withColumn("depth", upto)
    heads = depth.where("head is not null").select("file", "head.*", F.col("line_number").alias("start_line"), (F.col("depth") - F.col("delta")).alias("base"))
    ends = depth.where("delta < 0").select("file", F.col("line_number").alias("at"), "depth")
    last = files.where("text is not null").groupBy("file").agg(F.max(F.size(F.split("text", "\n"))).alias("last_line"))
    closed = heads.join(ends, "file", "left").groupBy("file", "function_name", "parameters", "start_line").agg(F.min(F.when((F.col("at") > F.col("start_line")) & (F.col("depth") <= F.col("base")), F.col("at"))).alias("end_line"))
    return closed.join(last, "file").select("file", "function_name", "parameters", "start_line", F.coalesce("end_line", "last_line").alias("end_line"))


def in_functions(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """rows (file, line_number, ...) with function_name of the innermost function that holds the line; null for none."""
    own = [c for c in rows.columns if c != "function_name"]
    # Lines and functions meet by bands of lines, so a line isn't joined with all functions of its file.
    band = lambda at: F.floor(F.col(at) / BAND)
    banded = scopes.where("start_line <= end_line").select("file", "function_name", "start_line", "end_line", F.explode(F.sequence(band("start_line"), band("end_line"))).alias("__band"))
    held = rows.select(*own, band("line_number").alias("__band")).join(banded, ["file", "__band"], "left")
    inside = F.col("line_number").between(F.col("start_line"), F.col("end_line"))
    return held.groupBy(*own).agg(F.max_by("function_name", F.when(inside, F.col("start_line"))).alias("function_name"))


def imports(files: DataFrame) -> DataFrame:
    """(file, line_number, imported)."""
    return lines(files).where(F.col("line").rlike(IMPORT)).select("file", "line_number", F.regexp_extract("line", IMPORT, 1).alias("imported"))


def class_records(files: DataFrame) -> DataFrame:
    """(file, line_number, class_name, superclass); superclass is null for none."""
    return lines(files).where(F.col("line").rlike(CLASS)).select("file", "line_number", F.regexp_extract("line", CLASS, 1).alias("class_name"), F.nullif(F.regexp_extract("line", CLASS, 2), F.lit("")).alias("superclass"))


def static_sources(files: DataFrame) -> DataFrame:
    """(file, line_number, variable, source_type, confidence): variables that are set by a call that brings in data."""
    pattern = rf"({NAME})\s*=\s*[^=;]*\.(?:{INPUT_CALLS})\("
    # The calls' names alone tell most lines that have none, at a fraction of the cost.
    named = functools.reduce(operator.or_, [F.col("line").contains(f".{x}(") for x in INPUT_CALLS.split("|")])
    rows = lines(files).where(F.col("line").contains("=") & named & F.col("line").rlike(pattern))
    return rows.select("file", "line_number", F.regexp_extract("line", pattern, 1).alias("variable"), F.lit("external_data").alias("source_type"), F.lit(0.86).alias("confidence"))


def _harm(method: str) -> Column:
    """The kind of harm that a call may do; null for none."""
    return F.coalesce(*[F.when(F.col(method).isin(p.split("|")), t) for t, p in SINKS])


def static_sinks(files: DataFrame) -> DataFrame:
    """(file, line_number, variable, vuln_type, confidence): the first variable among the arguments of a harmful call."""
    kind = _harm("method")
    rows = calls(files).where(kind.isNotNull()).select("file", "line_number", F.try_element_at(names_in(F.regexp_replace("arguments", r'"[^"]*"', '""')), F.lit(1)).alias("variable"), kind.alias("vuln_type"))
    return rows.where("variable is not null").withColumn("confidence", F.lit(0.9))


def static_sanitizers(files: DataFrame) -> DataFrame:
    """(file, line_number, sanitizer, protects, effectiveness, variable): a row for each rule that a line matches.

    The rules are a fixed list, so a line is tested against all of them in one projection, without a join. variable is
    the target of the assignment, else the receiver of the call.
    """
    rules = F.array(*[F.when(has(F.col("line"), p), F.struct(F.lit(t).alias("sanitizer"), F.lit(v).alias("protects"), F.lit(e).alias("effectiveness"))) for t, v, e, p in SANITIZERS])
    variable = F.coalesce(F.nullif(F.regexp_extract("line", STATEMENT, 1), F.lit("")), F.nullif(F.regexp_extract("line", CALL, 1), F.lit("")))
    return lines(files).select("file", "line_number", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("x"), variable.alias("variable")).select("file", "line_number", "x.*", "variable")


def redacted(text: Column) -> Column:
    """The text with the values of passwords, tokens and keys struck out."""
    return F.regexp_replace(text, SECRET, "$1$2***")


def first_occurrences(files: DataFrame) -> DataFrame:
    """(file, variable, line_number, line): where each variable stands first."""
    rows = lines(files).select("file", "line_number", "line", F.explode(names_in(F.col("line"))).alias("variable"))
    return rows.groupBy("file", "variable").agg(F.min(F.struct("line_number", "line")).alias("x")).select("file", "variable", "x.*")


def owned_calls(files: DataFrame) -> DataFrame:
    """(file, line_number, method, arguments, owner, parameters): calls of functions that exactly one file defines.

    Names that several files define are ambiguous and are left out before the join, so the owners' side has one row
    for each name; where the functions end is not asked.
    """
    once = heads(files).where("file is not null").groupBy("function_name").agg(F.count_distinct("file").alias("n"), F.min(F.struct("file", "start_line", "parameters")).alias("x"))
    owners = once.where("n = 1").select(F.col("function_name").alias("method"), F.col("x.file").alias("owner"), F.col("x.parameters").alias("parameters"))
    return calls(files).join(owners, "method").select("file", "line_number", "method", "arguments", "owner", "parameters")


def call_bridges(files: DataFrame) -> DataFrame:
    """(file, line_number, method, argument, owner, parameter): the variables of a call and, by position, the parameters
    of the function in another file that they become. The shorter of both lists decides."""
    named = lambda x, at: F.transform(F.split(F.regexp_replace(x, r'"[^"]*"', '""'), ","), lambda p: F.regexp_extract(p, at, 1))
    rows = owned_calls(files).where("file <> owner")
    pairs = F.arrays_zip(named("arguments", rf"({NAME})").alias("argument"), named("parameters", rf"({NAME})\s*$").alias("parameter"))
    return rows.select("file", "line_number", "method", "owner", F.explode(pairs).alias("x")).select("file", "line_number", "method", "x.argument", "owner", "x.parameter").where("argument <> '' and parameter <> ''")


def statement_of(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file, from_var, to_var, line_number): the first line on which both ends of an edge stand: an inverted index of
    variables joined with itself on the line, but only for the variables of edges."""
    index = lines(files).select("file", "line_number", F.explode(names_in(F.col("line"))).alias("variable"))
    a = edges.select("file", "from_var", "to_var").distinct().join(index.withColumnRenamed("variable", "from_var"), ["file", "from_var"])
    both = a.join(index.withColumnRenamed("variable", "to_var"), ["file", "to_var", "line_number"])
    return both.groupBy("file", "from_var", "to_var").agg(F.min("line_number").alias("line_number"))


def flow_statements(flows: DataFrame) -> DataFrame:
    """(file, from_var, to_var, line_number, n): the first line of each flow and how often it is found."""
    return flows.groupBy("file", "from_var", "to_var").agg(F.min("line_number").alias("line_number"), F.count(F.lit(1)).alias("n"))


def arrow_edges(files: DataFrame) -> DataFrame:
    """(file, line_number, src, dst): edges written as a -> b, one on a line; blank lines, remarks (#) and lines with more
    arrows are none."""
    part = F.transform(F.split("line", "->"), lambda x: F.trim(x, F.lit(" \t\r")))
    rows = lines(files).where(~F.trim("line").startswith("#")).select("file", "line_number", part.alias("part")).where(F.size("part") == 2)
    return rows.select("file", "line_number", F.col("part")[0].alias("src"), F.col("part")[1].alias("dst")).where("src <> '' and dst <> ''")
