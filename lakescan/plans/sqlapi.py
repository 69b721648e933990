"""Read-only SQL over the session's views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.profile import summarize

STARTS = ("select", "with", "describe", "desc", "summarize", "explain", "show", "values", "table", "from")
READS = re.compile(r"(Explain|Show|Describe)\w*")
SUMMARIZE = re.compile(r"\s*summarize\s+([\w.`]+)\s*;?\s*", re.I)
SUMMARIZED = re.compile(r"summarize\s*(?=[\s(])", re.I)
COMMAND = re.compile(r"Command$|Statement$|^(Create|Drop|Insert|Delete|Update|Merge|Alter|Truncate|Replace|Set|Add|Load|Cache|Uncache|Refresh|Analyze|Repair|Append|Overwrite|Call|Comment|Execute|Declare)")


#: Expressions of the analysed plan that run code of the session or the JVM, and functions that do so under a name.
RUNS_CODE = re.compile(r"^(CallMethodViaReflection|TryReflect|ScalaUDF|PythonUDF|PythonUDTF|PythonUDAF|HiveSimpleUDF|HiveGenericUDF|HiveUDAFFunction|HiveGenericUDTF|ScalaAggregator|ScalaUDAF|Invoke|StaticInvoke|NewInstance)$")
#: The names under which Spark has them.
REFLECTING = ("java_method", "reflect", "try_reflect")


def bare(sql: str) -> str:
    """Without leading blanks, ``--`` lines and parentheses."""
    return re.sub(r"\A(\s|\(|--[^\n]*(\n|\Z))+", "", sql)


def _nodes(plan):
    """The plan's nodes, also those inside others; expressions among them carry no statements."""
    yield plan
    for side in ("children", "innerChildren"):
        found = getattr(plan, side)()
        for i in range(found.size()):
            if "innerChildren" in dir(child := found.apply(i)):
                yield from _nodes(child)


def _expressions(plan):
    """All expressions of a plan, of the plans inside it, and of the plans inside expressions."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        for side in ("children", "innerChildren"):
            found = getattr(node, side)()
            waiting += [c for i in range(found.size()) if "expressions" in dir(c := found.apply(i))]
        deep = [node.expressions().apply(i) for i in range(node.expressions().size())]
        while deep:
            e = deep.pop()
            yield e
            deep += [e.children().apply(i) for i in range(e.children().size())]
            if "plan" in dir(e) and hasattr(e.plan(), "expressions"):
                waiting.append(e.plan())


def _runs_code(e) -> bool:
    """Calls into the JVM or of functions that the session was given; Spark replaces some of its own functions by calls of its own classes."""
    name = e.getClass().getSimpleName()
    if name == "UnresolvedFunction":
        return e.nameParts().last().lower() in REFLECTING
    if name == "StaticInvoke":
        return not e.staticObject().getName().startswith(("org.apache.spark.", "java.net.URL"))
    if name == "Invoke":
        return not (e.targetObject().getClass().getSimpleName() == "Literal" and e.targetObject().dataType().getClass().getName().startswith("org.apache.spark."))
    return bool(RUNS_CODE.match(name))


def check_read_only(spark: SparkSession, sql: str, functions: bool = False) -> None:
    """Raises ``ValueError`` unless the text is one statement that only reads and runs no code.

    The first word is tested, and the parsed tree is walked as a whole: ``WITH ... INSERT`` and ``FROM t INSERT INTO u``
    begin with allowed words. The parser itself refuses a second statement and takes a quoted semicolon for text. What a
    function's name comes to, however it is written, shows in the analysed plan only, so methods of the JVM are looked for
    there; ``functions`` allows the session's own Python and JVM functions.
    """
    words = re.match(r"[A-Za-z]+", bare(sql))
    if not words or words[0].lower() not in STARTS:
        raise ValueError("only reading statements are allowed")
    if SUMMARIZE.fullmatch(bare(sql)):
        return
    if of := SUMMARIZED.match(bare(sql)):
        return check_read_only(spark, bare(sql)[of.end() :], functions)
    state = spark._jsparkSession.sessionState()
    plan = state.sqlParser().parsePlan(sql)
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        if COMMAND.search(name) and not READS.match(name):
            raise ValueError(f"not a reading statement: {name}")
    _check_expressions(plan, functions)  # before the analyser looks a class up
    for node in _nodes(plan):  # EXPLAIN holds its statement as parsed
        inner = node.logicalPlan() if node.getClass().getSimpleName() == "ExplainCommand" else None
        if inner is not None:
            _check_expressions(state.executePlan(inner, _mode(spark)).analyzed(), functions)
    if not READS.match(plan.getClass().getSimpleName()):
        _check_expressions(state.executePlan(plan, _mode(spark)).analyzed(), functions)


def _mode(spark: SparkSession):
    """Analyse without running what commands would run."""
    return getattr(spark._jvm.org.apache.spark.sql.execution, "CommandExecutionMode").withName("SKIP")


def _check_expressions(plan, functions: bool) -> None:
    for e in _expressions(plan):
        name = e.getClass().getSimpleName()
        if _runs_code(e) and not (functions and "UDF" in name):
            raise ValueError(f"functions that run code are not allowed: {name}")


def query(spark: SparkSession, sql: str, limit: int | None = 100) -> tuple[DataFrame, int | None]:
    """A frame of at most ``limit`` + 1 rows; one more than ``limit`` says that there are more. ``SUMMARIZE`` of a table or a query is its profile."""
    check_read_only(spark, sql)
    text = bare(sql)
    if m := SUMMARIZE.fullmatch(text):
        df = summarize(spark.table(m[1]))
    elif m := SUMMARIZED.match(text):
        df = summarize(spark.sql(text[m.end() :]))
    else:
        df = spark.sql(sql)
    return (df.limit(limit + 1) if limit is not None else df), limit
