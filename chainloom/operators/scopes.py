"""What stands where in source text: fields, locals, roots of calls, definitions and uses, values that survive, and the
operation that uses a variable next.

Candidates meet on equal (file, variable) or (file, function), never by comparing all lines of a file.

Defined results: null texts give no rows; text in quotes and remarks is no use; repeated rows give one row, as all results
are facts about a name; of equally near lines the later, then the least; empty tables give none.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.operators.source_text import KEYWORDS, NAME, STATEMENT, functions, in_functions, lines, names_in, without_comments

# What makes a function worth a look.
FUNCTION_RELEVANT = (
    r"getParameter|getHeader|getCookies|getInputStream|getReader|getQueryString"
    r"|@RequestParam|@PathVariable|@RequestBody|@RequestHeader|@CookieValue"
    r"|@QueryParam|@FormParam|@HeaderParam|@PathParam"
    r"|HttpServletRequest|HttpServletResponse"
    r"|executeQuery|executeUpdate|prepareStatement|createStatement|execute\("
    r"|createNativeQuery|createQuery"
    r"|Runtime\.getRuntime|ProcessBuilder|exec\("
    r"|setAttribute|getRequestDispatcher|sendRedirect|addCookie|\.write\("
    r"|innerHTML|document\.write|\.html\("
    r"|new\s+File\(|new\s+FileInputStream|Paths\.get|Files\."
    r"|DocumentBuilder|SAXParser|XMLReader|TransformerFactory"
    r"|URL\(|HttpURLConnection|HttpClient|openConnection"
    r"|ObjectInputStream|readObject|XMLDecoder|Class\s*\.\s*forName|classForName|\.deserialize\s*\("
    r"|getAttribute"
    r"|ScriptEngine|GroovyShell|GroovyClassLoader|BeanShell|Interpreter"
    r"|SpelExpressionParser|ExpressionParser|MVEL|OGNL|Janino"
    r"|\.eval\s*\(|evaluate\s*\(|parseExpression|parseClass|compile\s*\(|defineClass"
    r"|ClassLoader|MethodHandles|\.invoke\s*\(|getDeclaredMethod"
    r"|Template|Renderer|render\s*\(|processTemplate|mergeTemplate"
    r"|getWriter\s*\(|getOutputStream\s*\(|sendError\s*\("
    r"|setHeader\s*\(|addHeader\s*\(|setStatus\s*\("
)
# The calls in which harm of each kind is done.
OPERATIONS = (
    ("command_injection", "exec command start"),
    ("sql_injection", "execute executeQuery executeUpdate executeBatch prepareCall prepareStatement createQuery createNativeQuery"),
    ("xss", "append format printf print println write sendError setHeader addHeader"),
    ("path_traversal", "get newInputStream newOutputStream readAllBytes readString write copy move delete"),
    ("open_redirect", "sendRedirect redirect setHeader addHeader"),
    ("ssrf", "openConnection openStream send execute"),
    ("code_injection", "eval evaluate invoke forName parseClass parseExpression compile defineClass"),
    ("deserialization", "readObject readValue deserialize fromXML"),
    ("xxe", "parse unmarshal transform"),
)
# Classes whose making counts as an operation, and for which kinds.
CONSTRUCTORS, CONSTRUCTED = "ProcessBuilder File FileInputStream FileOutputStream URL URI", ("command_injection", "path_traversal", "ssrf")
OPERATIONS = tuple((k, f"{names} {CONSTRUCTORS}" if k in CONSTRUCTED else names) for k, names in OPERATIONS)
#: Lines around a line within which a use counts as near.
NEAR = 5
VISIBLE = r"[^ \t\n\r\f\x0b]"
INVOKED = rf"{NAME}\.{NAME}\(|\bnew +[A-Z]"
FIELD = rf"^\s*(?:(?:public|private|protected|static|final|volatile|transient)\s+)*([A-Za-z_][A-Za-z0-9_.<>\[\], ?]*?)\s+({NAME})\s*(?:=[^=].*)?;\s*$"
LOCAL = rf"^\s*(?:final\s+)?(?:[A-Z][A-Za-z0-9_]*|int|long|boolean|double|float|byte|char|short|var)(?:<[^;=()]*>)?(?:\[\])?\s+({NAME})\s*[=;]"
CAUGHT = rf"\bcatch\s*\([^()]*?({NAME})\s*\)"
EACH = rf"\bfor\s*\(\s*(?:final\s+)?[^\s;()]+\s+({NAME})\s*:"
CHAINED = rf"({NAME})(?:\.{NAME}(?:\([^()]*\))?)*\.({NAME})\("
# A call with what stands in its parentheses, which may hold calls, and the innermost calls.
OUTER, INNER = rf"({NAME})\(((?:[^()]|\([^()]*\))*)\)", rf"({NAME})\(([^()]*)\)"
SET = rf"({NAME})\s*=\s*([^=;][^;]*);"


def plain(text: Column) -> Column:
    """A line without the text in its quotes and without what follows two strokes."""
    return F.regexp_replace(F.regexp_replace(text, r'"[^"]*"', '""'), r"//.*$", "")


def census(files: DataFrame, group: str) -> DataFrame:
    """(group, files, without_text, remarks_only, without_calls) of files (group, text): what a look would be lost on."""
    code = without_comments(F.col("text"))
    said = F.coalesce(F.col("text").rlike(VISIBLE), F.lit(False))
    coded = F.coalesce(code.rlike(VISIBLE), F.lit(False))
    rows = files.select(group, said.alias("said"), coded.alias("coded"), F.coalesce(code.rlike(INVOKED), F.lit(False)).alias("called"))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("said")).alias("without_text"), F.count_if(F.col("said") & ~F.col("coded")).alias("remarks_only"), F.count_if(F.col("coded") & ~F.col("called")).alias("without_calls"))


def relevant_functions(files: DataFrame) -> DataFrame:
    """(file, function_name, start_line, relevant): whether a line of the function, its head included, is worth a look."""
    own = functions(files).select("file", "function_name", "start_line", "end_line").distinct()
    told = lines(files).where(F.col("line").rlike(FUNCTION_RELEVANT)).groupBy("file").agg(F.collect_list("line_number").alias("at"))
    # The lines of one text only, so the list is bounded by the text that its row came from.
    inside = F.exists("at", lambda n: n.between(F.col("start_line"), F.col("end_line")))
    return own.join(told, "file", "left").select("file", "function_name", "start_line", F.coalesce(inside, F.lit(False)).alias("relevant"))


def fields(files: DataFrame) -> DataFrame:
    """(file, line_number, field, type): declarations directly in a class body."""
    delta = F.length(F.regexp_replace("line", r"[^{]", "")) - F.length(F.regexp_replace("line", r"[^}]", ""))
    rows = lines(files).withColumn("delta", delta)
    rows = rows.withColumn("depth", F.sum("delta").over(Window.partitionBy("file").orderBy("line_number")))
    return rows.where((F.col("depth") == 1) & (F.col("delta") == 0) & F.col("line").rlike(FIELD)).select("file", "line_number", F.regexp_extract("line", FIELD, 2).alias("field"), F.trim(F.regexp_extract("line", FIELD, 1)).alias("type"))


def locals_of(files: DataFrame) -> DataFrame:
    """(file, function_name, n, names): parameters, declared, caught and loop variables; functions of one name of a file
    add up."""
    own = functions(files)
    every = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    given = own.select("file", "function_name", F.explode(F.transform(F.split("parameters", ","), lambda p: F.regexp_extract(p, rf"({NAME})\s*$", 1))).alias("name"))
    said = lines(files).select("file", "line_number", F.explode(F.concat(every("line", LOCAL), every("line", CAUGHT), every("line", EACH))).alias("name")).distinct()
    held = in_functions(said, own).where("function_name is not null").select("file", "function_name", "name")
    return given.unionByName(held).where("name <> ''").groupBy("file", "function_name").agg(F.collect_set("name").alias("x")).select("file", "function_name", F.size("x").cast("long").alias("n"), F.array_join(F.sort_array("x"), ",").alias("names"))


def call_roots(files: DataFrame) -> DataFrame:
    """(file, line_number, root, method): the leftmost name and the last call of each chain of calls."""
    part = lambda i: F.regexp_extract_all("line", F.lit(CHAINED), F.lit(i))
    return lines(files).select("file", "line_number", F.explode(F.arrays_zip(part(1).alias("root"), part(2).alias("method"))).alias("x")).select("file", "line_number", "x.*")


def definitions_and_uses(files: DataFrame) -> DataFrame:
    """(file, variable, definitions, uses, first_definition): on how many lines a name is set and on how many it is read."""
    line = plain(F.col("line"))
    sets = line.rlike(STATEMENT)
    target = F.when(sets, F.array(F.regexp_extract(line, STATEMENT, 1))).otherwise(F.array().cast("array<string>"))
    read = names_in(F.when(sets, F.regexp_extract(line, STATEMENT, 2)).otherwise(line))
    named = lambda x, what: F.transform(x, lambda n: F.struct(n.alias("variable"), F.lit(what).alias("defines")))
    rows = lines(files).select("file", "line_number", F.explode(F.concat(named(target, True), named(read, False))).alias("x")).select("file", "line_number", "x.*")
    return rows.groupBy("file", "variable").agg(F.count_if("defines").alias("definitions"), F.count_if(~F.col("defines")).alias("uses"), F.min(F.when(F.col("defines"), F.col("line_number"))).alias("first_definition"))


def preserved(files: DataFrame) -> DataFrame:
    """(file, variable, first_line, last_line, preserved): whether the value of a name on its first line is still there on
    its last: no line between sets it from something that doesn't mention it. Null for names that stand on one line."""
    line = plain(F.col("line"))
    stands = lines(files).select("file", "line_number", F.explode(names_in(line)).alias("variable"))
    part = lambda i: F.regexp_extract_all(line, F.lit(SET), F.lit(i))
    sets = lines(files).select("file", "line_number", F.explode(F.arrays_zip(part(1).alias("variable"), part(2).alias("value"))).alias("x"))
    lost = sets.where(~F.array_contains(names_in(F.col("x.value")), F.col("x.variable"))).select("file", "line_number", F.col("x.variable").alias("variable"))
    # A name is lost exactly when its last foreign setting lies behind its first line, so two aggregates are enough.
    both = stands.groupBy("file", "variable").agg(F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"))
    rows = both.join(lost.groupBy("file", "variable").agg(F.max("line_number").alias("at")), ["file", "variable"], "left")
    return rows.select("file", "variable", "first_line", "last_line", F.when(F.col("last_line") > F.col("first_line"), F.coalesce(F.col("at") <= F.col("first_line"), F.lit(True))).alias("preserved"))


def set_variables(files: DataFrame) -> DataFrame:
    """(file, variable, line_number, function_name): where each name is first set in each function."""
    rows = lines(files).where(F.col("line").contains("=") & F.col("line").rlike(STATEMENT)).select("file", "line_number", F.regexp_extract("line", STATEMENT, 1).alias("variable")).distinct()
    return in_functions(rows, functions(files)).groupBy("file", "variable", "function_name").agg(F.min("line_number").alias("line_number"))


def argument_uses(files: DataFrame) -> DataFrame:
    """(file, variable, at, method, function_name): calls that take a variable as an argument."""
    part = lambda p, i: F.regexp_extract_all(plain(F.col("line")), F.lit(p), F.lit(i))
    calls = F.concat(*[F.arrays_zip(part(p, 1).alias("method"), part(p, 2).alias("arguments")) for p in (OUTER, INNER)])
    rows = lines(files).where(F.col("line").contains("(")).select("file", "line_number", F.explode(calls).alias("x")).where(~F.col("x.method").isin(KEYWORDS))
    rows = rows.select("file", "line_number", "x.method", F.explode(names_in(F.col("x.arguments"))).alias("variable")).distinct()
    return in_functions(rows, functions(files)).withColumnRenamed("line_number", "at")


def _nearest(at: str) -> list[Column]:
    apart = F.col(at) - F.col("line_number")
    return [F.abs(apart), apart < 0, F.col(at)]


def terminal_uses(files: DataFrame) -> DataFrame:
    """(file, function_name, variable, line_number, vuln_type, use_line): for each variable that a function sets the
    nearest operation of each kind that takes it in the same function."""
    kinds = F.array(*[F.struct(F.lit(k).alias("vuln_type"), F.array(*map(F.lit, names.split())).alias("methods")) for k, names in OPERATIONS])
    uses = argument_uses(files).select("file", "variable", "at", "function_name", F.explode(F.filter(kinds, lambda k: F.array_contains(k["methods"], F.col("method")))).alias("k"))
    uses = uses.select("file", "variable", "at", "function_name", "k.vuln_type").where("function_name is not null")
    key = ["file", "function_name", "variable"]
    met = set_variables(files).join(uses, key)
    return met.groupBy(*key, "line_number", "vuln_type").agg(F.min(F.struct(*_nearest("at"))).alias("x")).select(*key, "line_number", "vuln_type", F.col("x.at").alias("use_line"))


def nearest_uses(files: DataFrame) -> DataFrame:
    """(file, function_name, variable, line_number, use_line, tier): for each variable that is set the call that uses it: on
    its line (0), within NEAR lines (1), in its function (2), anywhere in the file (3), nearest first; where nothing uses
    it, its own line (4)."""
    uses = argument_uses(files).select("file", "variable", "at", F.col("function_name").alias("used_in")).distinct()
    met = set_variables(files).join(uses, ["file", "variable"], "left")
    apart = F.abs(F.col("at") - F.col("line_number"))
    tier = F.when(F.col("at").isNull(), 4).when(apart == 0, 0).when(apart <= NEAR, 1).when(F.col("used_in").eqNullSafe(F.col("function_name")), 2).otherwise(3)
    best = met.groupBy("file", "function_name", "variable", "line_number").agg(F.min(F.struct(tier.alias("tier"), *_nearest("at"))).alias("x"))
    return best.select("file", "function_name", "variable", "line_number", F.coalesce("x.at", "line_number").alias("use_line"), "x.tier")


def guarded(bridges: DataFrame, sources: DataFrame) -> DataFrame:
    """Bridges (file, argument, function_name, ...) without those that would borrow a source of another method: where the
    caller's file has sources (file, variable, function_name) of the argument's name that stand in functions, and the call
    stands in one, one of them must be its own."""
    known = sources.where("function_name is not null").groupBy("file", F.col("variable").alias("argument")).agg(F.collect_set("function_name").alias("owners"))
    rows = bridges.join(known, ["file", "argument"], "left")
    kept = F.col("owners").isNull() | F.col("function_name").isNull() | F.array_contains("owners", F.col("function_name"))
    return rows.where(kept).select(*bridges.columns)
