import json
import math
import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from quorumql.functions import coerce, messages, sqltext, text
from quorumql.functions.cells import canonical_cells, shown_cells
from quorumql.functions.render import fixed_or_na, general_format, json_text, render_value
from quorumql.operators import previews
from quorumql.operators.profiling import date_looking, numeric_looking

ANSWERS = [
    # text, statement, read-only
    ("SELECT 7", "SELECT 7", True),
    ("```sql\nSELECT 7;\n```", "SELECT 7", True),
    ("x ```python\nselect 1``` y", "python\nselect 1", False),
    ("```sqlite select 1```", "ite select 1", False),
    ("<think>a ```drop```</think> ```SQL\nselect 7```", "select 7", True),
    ("<think>no end; select 1", "<think>no end", False),
    ("```sql\nselect 1", "```sql\nselect 1", False),
    ("select 1; select 2", "select 1", True),
    ("select ';' -- c;\n, 2", "select ';' \n, 2", True),
    ("/* x; */ select 1", "select 1", True),
    ("select 1 /* open ; to the end", "select 1", True),
    ("select/**/1", "select1", True),
    ("select 'it''s;' ; x", "select 'it''s;'", True),
    ('select "a;""b" ; x', 'select "a;""b"', True),
    ("select `a;b` ; x", "select `a;b`", True),
    ("a 'unterminated ; x", "a 'unterminated ; x", False),
    ("DROP TABLE t", "DROP TABLE t", False),
    ("select 'drop'", "select 'drop'", True),
    ("SELECT REPLACE(a,'x','y')", "SELECT REPLACE(a,'x','y')", False),
    ("select 1 -- drop", "select 1", True),
    ("( select 1)", "( select 1)", False),
    ("((select 1))", "((select 1))", True),
    ("selection", "selection", True),
    ("explain select 1", "explain select 1", True),
    ("select 1; \x01; drop", "select 1", True),
    ("\x01a;\x01;", "\x01a", False),
    ("", "", False),
    (" ;; ; ", ";; ;", False),
    (" select 1 ", "select 1", True),
]


def test_extract_sql(evaluate_column):
    found = evaluate_column([a for a, _, _ in ANSWERS], "string", sqltext.extract_sql(F.col("v")))
    assert found == [s for _, s, _ in ANSWERS]


def test_read_only(evaluate_column):
    found = evaluate_column([s for _, s, _ in ANSWERS], "string", sqltext.is_read_only(F.col("v")))
    assert found == [r for _, _, r in ANSWERS]


def test_read_only_with_open_literals(evaluate_column):
    values = ["select 'a''drop", "select 'drop''x", "select 'drop", "select '", "select '''", 'select "drop""x', "select 'x' || \"drop\""]
    # A literal that never closes ends at its last doubled quote; without one it is not a literal.
    assert evaluate_column(values, "string", sqltext.is_read_only(F.col("v"))) == [False, True, False, True, True, True, True]


def test_split_statements(evaluate_column):
    values = ["a; b ;c", "'x;y';z", "--only\n", "a--b\n;c", "/*", "a/b-c;d", None]
    assert evaluate_column(values, "string", sqltext.split_statements(F.col("v"))) == [
        ["a", "b", "c"], ["'x;y'", "z"], [], ["a", "c"], [], ["a/b-c", "d"], []]


def _split_by_hand(sql):
    """Character walk used as an independent check."""
    out, piece, quote, i = [], [], None, 0
    while i < len(sql):
        two = sql[i:i + 2]
        if quote:
            if sql[i] == quote and quote != "`" and two == quote * 2:
                piece.append(two)
                i += 2
                continue
            if sql[i] == quote:
                quote = None
        elif two == "--":
            end = sql.find("\n", i)
            i = len(sql) if end < 0 else end
            continue
        elif two == "/*":
            end = sql.find("*/", i + 2)
            i = len(sql) if end < 0 else end + 2
            continue
        elif sql[i] == ";":
            out.append("".join(piece).strip())
            piece = []
            i += 1
            continue
        elif sql[i] in "'\"`":
            quote = sql[i]
        piece.append(sql[i])
        i += 1
    out.append("".join(piece).strip())
    return [s for s in out if s]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="a '\"`;-/*\n\x01", max_size=24), min_size=200, max_size=300))
def test_split_statements_random(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").orderBy("i")
    found = [r[0] for r in rows.select(sqltext.split_statements(F.col("v"))).collect()]
    assert found == [_split_by_hand(v) for v in values]


def test_long_literals_do_not_exhaust_the_regex_stack(evaluate_column):
    value = "select '" + "x''" * 50_000 + "', 1; drop table t"
    open_value = "select '" + "x''" * 50_000
    assert len(evaluate_column([value], "string", sqltext.extract_sql(F.col("v")))[0]) == len(value) - len("; drop table t")
    assert evaluate_column([value, open_value], "string", sqltext.is_read_only(F.col("v"))) == [False, True]


def test_normalize_sql(evaluate_column):
    values = ["  SELECT\t'A' ;;", "1; ;", ";;", "a\n\n b c", "x;y;", None]
    assert evaluate_column(values, "string", sqltext.normalize_sql(F.col("v"))) == ["select 'a'", "1;", "", "a b c", "x;y", None]


def test_exact_match(evaluate_column):
    values = ["SELECT 1;", "", None, "select 2"]
    assert evaluate_column(values, "string", sqltext.exact_match(F.col("v"), F.lit("select  1"))) == [True, False, False, False]


def test_strip_and_clip(evaluate_column):
    assert evaluate_column(["\t a \x1c\n", ""], "string", text.strip(F.col("v"))) == ["a", ""]
    assert evaluate_column(["abcdef", "abc"], "string", text.clip(F.col("v"), 4)) == ["abcd...", "abc"]


def test_render_values(evaluate_column):
    show = lambda kind: render_value(F.col("v"), kind)
    assert evaluate_column(
        [None, 5.0, 1234567.0, 0.00001234, 0.0, 0.5, 3977945.0], "double", show(T.DoubleType())
    ) == [None, "5", "1.23457e+06", "1.234e-05", "0", "0.5", "3.97794e+06"]
    long = "x" * 41
    assert evaluate_column(["it's", long, "a\nb ", None, "x" * 40], "string", show(T.StringType())) == [
        "'it''s'", "'" + "x" * 37 + "...'", "'a b'", None, "'" + "x" * 40 + "'"]
    assert evaluate_column([7, None], "bigint", show(T.LongType())) == ["7", None]


def test_general_format_agrees_with_python(evaluate_column):
    rng = random.Random(5)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 15) for _ in range(3000)]
    values += [rng.randint(0, 10**8) / 2 ** rng.randint(0, 12) for _ in range(3000)]
    values += [round(rng.uniform(0, 1e6), 2) for _ in range(3000)] + [math.inf, -math.inf, 999999.5, 9999995.0]
    assert evaluate_column(values, "double", general_format(F.col("v"))) == ["%.6g" % v for v in values]


def test_fixed_or_na(evaluate_column):
    values = [0.5, 0.00005, 0.00004999, -0.00007, 0.99995, 12.34565, 0.0, 0.03125] + [i / 20000 for i in range(200)]
    assert evaluate_column([*values, None], "double", fixed_or_na(F.col("v"))) == ["%.4f" % v for v in values] + ["n/a"]


def test_json_text(evaluate_column):
    assert evaluate_column(['a"b\\\n', "é/"], "string", json_text(F.col("v"))) == ['"a\\"b\\\\\\n"', '"é/"']


def test_numeric_and_date_looks(evaluate_column):
    yes = ["2024-01-01", "1-2", " 7 ", "1.5", "-3"]
    no = ["2024-01-01 00:00", "1e5", "+3", "1,000", "..", "2024/01/01", "", "-", "7\n"]
    assert evaluate_column(yes + no, "string", numeric_looking(F.col("v"))) == [True] * len(yes) + [False] * len(no)
    dates = ["2024-01-01", "2024-01-01T00", "2024/01/01", "01/02/2024 x"]
    assert evaluate_column(dates + ["24-01-01", "1/2/2024"], "string", date_looking(F.col("v"))) == [True] * 4 + [False] * 2


def test_coerce(evaluate_column):
    values = ["3.9", "-3.9", " ", "x", None, "1e3", "3d", "1_0", " 7 ", "nan"]
    assert evaluate_column(values, "string", coerce.to_int(F.col("v"))) == [3, -3, None, None, None, 1000, None, 10, 7, None]
    pairs = ["2024-01-01T00:00:00", "2024-01-01T00:01:30.5", "bad", None]
    assert evaluate_column(pairs, "string", coerce.iso_seconds(F.lit("2024-01-01T00:00:00"), F.col("v"))) == [0.0, 90.5, None, None]


def test_argument_sql(evaluate_column):
    values = ['{"sql": " select 1 \\n"}', '{"sql": 5}', "nope", '["sql"]', None, "{}", '{"sql": null}']
    assert evaluate_column(values, "string", messages.argument_sql(F.col("v"))) == ["select 1", "", "", "", "", "", ""]


def cells_of(df, **kwargs):
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return named.select(canonical_cells(named, **kwargs)).collect()[0][0]


def test_canonical_cells_agree_across_types(spark):
    same = spark.sql("SELECT 1, 1L, 1.0D, CAST(1 AS DECIMAL(10, 2)), true, 1.0000004D, CAST(1 AS FLOAT)")
    assert set(cells_of(same)) == {"d:1"}
    other = spark.sql("SELECT '1', X'AB', 'ab', -0.0D, -1e-9D, NULL, DATE'2024-01-02', 0.1D + 0.2D, CAST(0.3 AS DECIMAL(5, 3)), 1e16D, 10000000000000000L")
    assert cells_of(other) == ["s:1", "s:ab", "s:ab", "d:0", "d:0", None, "s:2024-01-02", "d:0.3", "d:0.3", "d:10000000000000000", "d:10000000000000000"]


def test_canonical_cells_keep_small_differences(spark):
    df = spark.sql("SELECT 12345678.5D, CAST(12345678.5 AS DECIMAL(20, 4)), 1e300D, double('NaN'), 9007199254740993L, 9007199254740992D")
    first, second, huge, nan, odd, even = cells_of(df)
    assert first == second == "d:12345678.5"
    assert huge == "d:1.0E300" and nan == "d:NaN" and odd != even
    assert cells_of(spark.sql("SELECT 0.126D"), precision=2) == ["d:0.13"]


def test_odd_column_names_are_fine(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS b").toDF("x", "y.`z")
    assert df.select(canonical_cells(df)).collect()[0][0] == ["d:1", "d:2"]


def test_statements_of_texts_with_separators(evaluate_column):
    texts = ["a; b", "a -- c; d\n; e", "x ';' y", "", ";;", "/* ; */ q"]
    assert evaluate_column(texts, "string", F.size(sqltext.split_statements(F.col("v")))) == [2, 2, 1, 0, 0, 1]


def test_large_doubles_equal_decimals(spark):
    df = spark.sql("SELECT 1e19D AS a, CAST(10000000000000000000 AS DECIMAL(38,0)) AS b, 2.50D AS c, -0.0D AS d, 9007199254740993D AS e, 0.1234567D AS f")
    cells = df.select(canonical_cells(df)).first()[0]
    assert cells[0] == cells[1] == "d:10000000000000000000" and cells[2:] == ["d:2.5", "d:0", "d:9007199254740992", "d:0.123457"]


def test_shown_cells_leave_values_alone(spark):
    df = spark.sql("SELECT 0.123456789D AS a, true AS b, 2.0D AS c, CAST('NaN' AS DOUBLE) AS d, 'x' AS e, CAST(NULL AS INT) AS f, CAST(1.50 AS DECIMAL(5,2)) AS g")
    rows = df.select(F.lit(0).cast("long").alias("index"), F.lit(0).alias("row_pos"), canonical_cells(df).alias("cells"), shown_cells(df).alias("shown"))
    queries = spark.createDataFrame([(0, "```sql\nselect 1;\n```", None, list("abcdefg"))], "index long, sql string, error string, columns array<string>")
    payload = json.loads(previews.previews(queries, rows).first().payload)
    assert payload["rows"] == [[0.123456789, True, 2.0, "NaN", "x", None, 1.5]] and payload["sql"] == "select 1"
