from pyspark.sql import functions as F

from deltaloom.functions import clang
from deltaloom.operators import changes, code

SOURCE = """#include "a.h"
#define MAX 3
/* adds { */
static int add(int a, int *out)
{
    int r = a + 1; // x {
    *out = r;
    g_total += r;
    if (a > MAX) { r++; } else { foo(a, &r); }
    return r;
}
#if 0
void dead(void) { }
#else
void live(void) { }
#endif
typedef struct { int x; char y[4]; } P_t;
"""


def test_scanner():
    found = clang.functions(clang.mask_dead(SOURCE))
    assert [(f["name"], f["line_start"], f["line_end"], f["params"]) for f in found] == [("add", 4, 11, ["int a", "int *out"]), ("live", 15, 15, [])]
    body = found[0]["body"]
    assert [(c["callee"], c["args"]) for c in clang.calls(body)] == [("foo", ["a", "&r"])]
    assert [(e["kind"], e["target"]) for e in clang.effects(body, found[0]["params"])] == [("param_write", "*out"), ("global_write", "g_total"), ("return", "")]
    assert [(b["kind"], b["parent"]) for b in clang.control_blocks(body)] == [("if", -1), ("else", -1)]
    assert [(m["struct"], m["member"], m["type"]) for m in clang.struct_members(SOURCE)] == [("P_t", "x", "int"), ("P_t", "y", "char[4]")]
    assert [v["name"] for v in clang.local_variables(body)] == ["r"]
    assert len(clang.mask(SOURCE)) == len(SOURCE)
    assert clang.split_top('f(a, b), "x,y", c[1,2]') == ["f(a, b)", '"x,y"', "c[1,2]"]
    tree = clang.expression_nodes("a + b * (c - 1) == f(x, y) && !p->q")
    assert [(n["kind"], n["text"]) for n in tree[:3]] == [("binary", "&&"), ("binary", "=="), ("binary", "+")]
    assert clang.functions("") == [] and clang.expression_nodes(None) == [] and clang.functions("int f( {") == []


def test_alignment(spark):
    files = lambda text: spark.createDataFrame([("x.c", text)], "rel_path string, content string")
    old = files("int a(void) {\n  one();\n}\nint b(void) {\n  two();\n}\n")
    new = files("int a(void) {\n  one();\n}\nint b(void) {\n  three();\n}\nint c(void) {\n  four();\n}\n")
    found = changes.code_changes(old, new)
    assert sorted((r.change_kind, r.function_name) for r in found.collect()) == [("modified_function", "b"), ("new_function", "c")]
    same = changes.code_changes(old, old)
    assert same.count() == 0
    note = files("// note\nint a(void) {\n  one();\n}\nint b(void) {\n  two();\n}\n")
    assert [r.change_kind for r in changes.code_changes(old, note).collect()] == ["file_global_changed"]


HEADER = """// top of file

/* Speed
 * of the motor */
// in rpm
#define SPEED(x) ((x) * \\
    2)
#define LIMIT 30 // most
enum mode { OFF, ON = 2, LAST };
typedef unsigned short u16_t;
typedef struct { int a; } pair_t;
extern u16_t g_speed[4];
int run(int mode,
        u16_t *out);
"""


def test_headers_and_comments(spark):
    files = spark.createDataFrame([("a.h", HEADER), ("b.h", ""), ("c.h", None)], "rel_path string, content string")
    got = {(r.ident, r.kind): (r.value, r.line) for r in code.header_symbols(files).collect()}
    assert got == {
        ("SPEED", "macro_function"): ("((x) * 2)", 6), ("LIMIT", "macro"): ("30", 8), ("OFF", "enumerator"): ("", 9), ("ON", "enumerator"): ("2", 9), ("LAST", "enumerator"): ("", 9),
        ("u16_t", "typedef"): ("unsigned short", 10), ("pair_t", "typedef"): ("struct", 11), ("g_speed", "variable"): ("u16_t[4]", 12), ("run", "prototype"): ("int (int mode, u16_t *out)", 13),
    }
    notes = clang.comments(HEADER)
    assert [(n["end_line"], n["next_line"]) for n in notes] == [(5, 6)] and notes[0]["text"] == "top of file\nSpeed\nof the motor\nin rpm"
    assert clang.joined_lines("a \\\n b\nc") == "a   b\n\nc" and clang.comments("") == [] and clang.header_symbols(None) == []
    chain = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "unsigned int"), ("X", "Y"), ("Y", "X")], "ident string, value string")
    assert {r.ident: r.base for r in code.typedef_bases(chain).collect()} == {"A": "unsigned int", "B": "unsigned int", "C": "unsigned int", "X": "X", "Y": "Y"}


def test_functions_by_comment_and_key(spark):
    text = "/* one */\nint f(void) {\n}\n/* far */\nint g;\nint h(void) {\n}\nint f(void) {\n  x();\n}\n"
    files = spark.createDataFrame([("a.c", text)], "rel_path string, content string")
    functions = code.function_table(files)
    assert {(r.name, r.ord): r.comment for r in code.preceding_comments(functions, code.comment_table(files)).collect()} == {("f", 0): "one"}
    assert sorted(r.name_key for r in code.duplicate_names(functions).collect()) == ["f", "f#2", "h"]
    assert spark.range(1).select(code.core_text(F.lit("int f() {\n a;\n}"))).first()[0] == " a;\n}"


def test_comments_and_patterns(spark):
    text = spark.createDataFrame([("f", "/**\n * @brief Adds\n * more\n * @param a left\n * @return sum\n */")], "name string, text string")
    assert {r.label: r.value for r in code.comment_fields(text).collect()}["brief"] == "Adds\nmore"
    lines = spark.createDataFrame([("f", "x = y;"), ("f", "if (x == 2)"), ("f", "return x;"), ("f", "x[1] = 3;")], "key string, text string")
    found = code.usage_patterns(lines, spark.createDataFrame([("f", "x")], "key string, symbol string"))
    assert {r.pattern: r.n for r in found.collect()} == {"assigned": 2, "compared": 1, "returned": 1, "indexed": 1}
    first = spark.createDataFrame([("a.c", "f", 1), ("a.c", "g", 5), ("a.c", "k", 1)], "rel_path string, name string, line int")
    second = spark.createDataFrame([("a.c", "f", 2), ("a.c", "g", 9), ("a.c", "h", 1)], "rel_path string, name string, line int")
    assert {r.name: r.status for r in code.cross_check(first, second).collect()} == {"f": "both", "g": "moved", "k": "only_first", "h": "only_second"}
    assert spark.range(1).select(code.classify(F.lit("set_speed"), [("^get_", "getter"), ("^set_", "setter")])).first()[0] == "setter"


def test_a_small_file_is_parsed_by_all_tasks(spark, sf_dir):
    from deltaloom.plans.code import project

    files = project(spark, sf_dir)
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sum(1 for n in files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n) > 1
