from pyspark.sql import functions as F

from deltaloom.functions import steps
from deltaloom.operators import code, facts

BODY = """int f(int a, int *out) {
    int r = a + 1;
    if (r > LIMIT) { r = LIMIT; } else if (a) { go(r, 2); } else { }
    for (i = 0; i < 3; i++) { s->state = r; }
    switch (a) { case 1: break; default: r++; }
    *out = r;
    weird stuff here now;
    return r;
}"""


def test_steps():
    found = steps.steps(BODY)
    assert [s["kind"] for s in found if s["kind"] != "end_block"] == ["assignment", "if", "assignment", "else_if", "call", "else", "for", "assignment", "switch", "case", "break", "default", "assignment", "assignment", "unknown", "return"]
    assert [s["is_empty"] for s in found if s["kind"] == "else"] == [1]
    lines = steps.render(found, {"r": "result"})
    assert "IF result > LIMIT" in lines and "    SET result TO LIMIT" in lines and "    CALL go(result, 2)" in lines and lines[-1] == "RETURN result" and "ELSE" not in lines
    assert steps.steps("") == [] and steps.render([]) == [] and steps.steps("if (") != []


def test_flows(spark):
    lines = spark.createDataFrame([("f", k, t) for k, t in enumerate(BODY.split("\n"))], "key string, ord int, text string")
    symbols = spark.createDataFrame([("f", "r", "int"), ("f", "a", "int")], "key string, symbol string, type string")
    functions = spark.createDataFrame([("f", "f", BODY)], "rel_path string, name string, body string")
    made = facts.step_table(functions).withColumnRenamed("rel_path", "key")
    sinks = facts.sink_patterns(made, symbols)
    assert {(r.symbol, r.pattern) for r in sinks.collect()} == {("r", "pointer_write"), ("r", "member_write"), ("r", "state_member_write"), ("r", "return_flow"), ("r", "argument")}
    assert {r.symbol: r.role for r in facts.roles(sinks).collect()}["r"] == "output"
    blocks = code.block_table(functions).withColumnRenamed("rel_path", "key")
    clamps = facts.clamped(blocks, made)
    assert [r.symbol for r in clamps.collect()] == ["r"]
    evidence = facts.symbol_evidence(made, symbols).unionByName(clamps.withColumn("evidence", F.lit("clamped")))
    assert {(r.symbol, r.role) for r in facts.dataflow_roles(evidence).collect()} == {("r", "output_value"), ("r", "state_output"), ("r", "return_value"), ("r", "clamp_result"), ("r", "counter_value")}
    flow = "void g(void) {\n  s_old = p->state_now;\n  if (s_old != p->state_now) { n = 0; }\n  n++;\n  if (n > 3) { brk_limit = read_it(n); }\n  ctl.outmax = brk_limit;\n}"
    made = facts.step_table(spark.createDataFrame([("g", "g", flow)], "rel_path string, name string, body string")).withColumnRenamed("rel_path", "key")
    named = spark.createDataFrame([("g", "s_old", "uint16"), ("g", "n", "int"), ("g", "brk_limit", "float")], "key string, symbol string, type string")
    got = {(r.symbol, r.role) for r in facts.dataflow_roles(facts.symbol_evidence(made, named)).collect()}
    assert got == {("s_old", x) for x in ("member_snapshot", "snapshot", "previous_snapshot", "change_baseline", "state_snapshot", "state_value")} | {("n", "counter_value"), ("n", "resettable_counter")} | {("brk_limit", x) for x in ("call_result", "output_limit", "limited_value", "brake_limit")}
    made = spark.createDataFrame([("f", "r = (int) read_it(a);")], "key string, text string")
    assert [(r.symbol, r.producer) for r in facts.producers(made, symbols).collect()] == [("r", "read_it")]
    assert [r.snippet for r in facts.usage_snippets(lines, symbols.where("symbol = 'a'"), 1).collect()] == ["int f(int a, int *out) {"]


def test_records(spark):
    body = "int f(int a, int *out) {\n  if (s->x > a) { s->x = t . y[2].z; go(a); }\n  while (a) { go(a); }\n  return a;\n}"
    functions = spark.createDataFrame([("f", "f", body, ["int a", "int *out"]), ("g", "g", "void g(void) { }", [])], "rel_path string, name string, body string, params array<string>")
    steps = facts.step_table(functions).withColumnRenamed("rel_path", "key")
    found = {r.key: r for r in facts.function_records(steps, code.parameter_table(functions).withColumnRenamed("rel_path", "key")).collect()}
    r = found["f"]
    assert (r.conditions, r.returns, r.callees) == (["s->x > a", "a"], ["a"], ["go"]) and r.members[0] == "s->x" and "t.y[2].z" in r.members
    assert [tuple(p) for p in r.parameters] == [("a", "input"), ("out", "input")]
    assert facts.function_records(steps.limit(0), code.parameter_table(functions.limit(0)).withColumnRenamed("rel_path", "key")).count() == 0


def test_confidence_and_choice(spark):
    no, yes = F.lit(False), F.lit(True)
    row = spark.range(1).select(facts.inferred_confidence(F.lit("x"), no, no, yes, no, no, no, no, no, F.lit(1)), facts.inferred_confidence(F.lit(""), no, yes, yes, no, no, no, no, no, F.lit(5)), facts.persist_scope(F.lit(0.84), F.lit(2), no), facts.persist_scope(F.lit(0.84), F.lit(2), yes), facts.payload_quality(F.lit(1), F.lit(0), F.lit(2), F.lit(0))).first()
    assert tuple(row) == (0.75, 0.0, "project", "session_only", 0.75)
    rows = "key string, quality double, misses_structure boolean, payload string"
    first = spark.createDataFrame([("a", 0.9, False, "A"), ("b", 0.2, False, "B"), ("c", 0.9, True, "C")], rows)
    back = spark.createDataFrame([("a", 1.0, False, "a"), ("b", 0.5, False, "b"), ("c", 0.1, False, "c"), ("d", 0.5, False, "d")], rows)
    assert {r.key: r.payload for r in facts.choose_provider(first, back).collect()} == {"a": "A", "b": "b", "c": "c", "d": "d"}
    rounds = spark.createDataFrame([("k", 0, 50), ("k", 1, 20), ("k", 2, 20), ("k", 3, 1), ("m", 0, 5)], "key string, round int, penalty int")
    assert {r.key: (r.round, r.penalty) for r in facts.regression_choice(rounds, 4).collect()} == {"k": (1, 20), "m": (0, 5)}


def test_lookups(spark):
    asked = spark.createDataFrame([(1, "a.c", "f"), (2, "x.c", "g"), (3, "x.c", "h"), (4, "q", "q")], "ask_id int, path string, name string")
    records = spark.createDataFrame([(10, "a.c", "f"), (11, "b.c", "f"), (12, "b.c", "g"), (13, "b.c", "h"), (14, "c.c", "h")], "record_id int, path string, name string")
    assert {r.ask_id: (r.record_id, r.step) for r in facts.lookup(asked, records, [["path", "name"], ["name"]]).collect()} == {1: (10, 0), 2: (12, 1)}
    functions = spark.createDataFrame([("a.c", "Init", 0), ("a.c", "run", 1)], "rel_path string, name string, ord int")
    failures = spark.createDataFrame([("a.c", "Init"), ("a.c", "RUN"), ("b.c", "zz")], "file_path string, func_name string")
    assert {r.func_name: (r.name, r.match) for r in facts.retry_tasks(failures, functions).collect()} == {"Init": ("Init", "exact"), "RUN": ("run", "case"), "zz": (None, "missing")}
    known = spark.createDataFrame([("m", "a", "A"), ("n", "b", "B"), ("n", "c", "C1"), ("o", "c", "C2")], "module string, name string, summary string")
    calls = spark.createDataFrame([("m", "x", c, k) for k, c in enumerate("abcdefgh")], "module string, caller string, callee string, ord int")
    assert [(r.callee, r.source) for r in facts.callee_summaries(known, calls).orderBy("rank").collect()] == [("a", "module"), ("b", "project"), ("c", "stub"), ("d", "stub"), ("e", "stub"), ("f", "stub")]
    defs = spark.createDataFrame([("A", "", "macro", 0), ("A", "one", "macro", 1), ("B", None, "macro", 2), ("c", "", "symbol", 3)], "ident string, cn string, kind string, ord int")
    assert {r.ident: (r.cn, r.translated) for r in facts.first_definitions(defs).collect()} == {"A": ("one", True), "B": (None, False)}
    one, two = (spark.createDataFrame([("a", v), (v, v)], "ident string, cn string") for v in ("x", "y"))
    assert {r.ident: r.cn for r in facts.layered(one, two).collect()} == {"a": "y", "x": "x", "y": "y"}


def test_output_text(spark):
    code = spark.createDataFrame([("/* USER CODE BEGIN A */new/* USER CODE END A */", {"A": "old $1 \\ x"})], "c string, b map<string,string>")
    assert code.select(facts.merge_user_blocks(F.col("c"), F.col("b"), ["A"])).first()[0] == "/* USER CODE BEGIN A */old $1 \\ x/* USER CODE END A */"
    functions = spark.createDataFrame([("m", 0, "int f(void)", "starts"), ("m", 1, "void g(int a)", None)], "module string, ord int, prototype string, brief string")
    macros = spark.createDataFrame([("m", 0, "MAX", "3", "most")], "module string, ord int, name string, value string, note string")
    assert facts.header_text(functions, macros).first().text == "#ifndef M_H\n#define M_H\n\n#define MAX 3 /* most */\n\n/* starts */\nint f(void);\nvoid g(int a);\n\n#endif\n"
    lines = spark.createDataFrame([("d", 0, "| a | 1 |"), ("d", 1, "text")], "doc string, ord int, text string")
    patches = spark.createDataFrame([("d", "a", "| a | 2 |")], "doc string, name string, row string")
    assert [r.text for r in facts.patch_markdown_rows(lines, patches).orderBy("ord").collect()] == ["| a | 2 |", "text"]


def test_sides_that_grow_are_not_broadcast(spark):
    """A parquet file of generated code looks small to the planner; its tables are joined by shuffles."""
    files = spark.createDataFrame([(f"{k}.c", BODY) for k in range(3)], "rel_path string, content string")
    functions = code.function_table(files)
    rows = facts.step_table(functions).withColumnRenamed("rel_path", "key")
    symbols = functions.select(F.col("rel_path").alias("key"), F.lit("r").alias("symbol"), F.lit("int").alias("type"))
    evidence = facts.symbol_evidence(rows, symbols)
    plan = evidence._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert plan.count("steps_udf") == 0  # steps were written once, so no branch parses again
    failures = functions.select(F.col("rel_path").alias("file_path"), F.col("name").alias("func_name"))
    assert "BroadcastHashJoin" not in facts.retry_tasks(failures, functions)._jdf.queryExecution().executedPlan().toString()
