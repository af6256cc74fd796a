import pytest
from pyspark.sql import functions as F

from quillshard.functions.formatting import InstructionFormatter, RowFormatter, full_text, with_prompt_target
from tests.conftest import plan_of

SCHEMA = "instruction string, input string, output string"


def formatted(spark, rows, formatter, schema=SCHEMA):
    df = with_prompt_target(spark.createDataFrame(rows, schema), formatter)
    return [(r.prompt, r.target) for r in df.select("prompt", "target").collect()]


DEFAULT = InstructionFormatter("instruction", "output", "input")


@pytest.mark.parametrize(
    "row, prompt, target",
    [
        (("do", "x", "y"), "Instruction: do\nInput: x\n\nResponse:", "y"),
        (("do", "", "y"), "Instruction: do\n\nResponse:", "y"),
        (("do", None, "y"), "Instruction: do\n\nResponse:", "y"),
        (("do", " ", "y"), "Instruction: do\nInput:  \n\nResponse:", "y"),
        ((None, None, None), "Instruction: None\n\nResponse:", "None"),
        (("", "", ""), "Instruction: \n\nResponse:", ""),
        (("a$1\\n{instruction}", "%s", "$0"), "Instruction: a$1\\n{instruction}\nInput: %s\n\nResponse:", "$0"),
    ],
)
def test_default_prompt(spark, row, prompt, target):
    assert formatted(spark, [row], DEFAULT) == [(prompt, target)]


def test_missing_fields_are_empty(spark):
    got = formatted(spark, [("do", "c", "r")], InstructionFormatter("instruction", "output", "input"), "instruction string, context string, response string")
    assert got == [("Instruction: do\n\nResponse:", "")]


def test_field_names_are_exact(spark):
    got = formatted(spark, [("do", "x", "y")], InstructionFormatter("Instruction", "output", None))
    assert got == [("Instruction: \n\nResponse:", "y")]


@pytest.mark.parametrize("field", [None, ""])
def test_no_input_field(spark, field):
    assert formatted(spark, [("do", "x", "y")], InstructionFormatter("instruction", "output", field))[0][0] == "Instruction: do\n\nResponse:"


@pytest.mark.parametrize(
    "template, row, prompt",
    [
        ("Q: {instruction} ({input})", ("a", "", "t"), "Q: a ()"),
        ("Q: {instruction} ({input})", ("a", None, "t"), "Q: a (None)"),
        ("{{x}} {input}{input}", ("a", "b", "t"), "{x} bb"),
        ("fixed", ("a", "b", "t"), "fixed"),
        ("", ("a", "b", "t"), ""),
        ("{instruction}", ("$1 \\ {input} %d", "b", "t"), "$1 \\ {input} %d"),
    ],
)
def test_template(spark, template, row, prompt):
    assert formatted(spark, [row], InstructionFormatter("instruction", "output", "input", template))[0][0] == prompt


@pytest.mark.parametrize("template, error", [("{who}", KeyError), ("{}", IndexError), ("{0}", IndexError), ("{input!r}", ValueError), ("{input:>9}", ValueError), ("{input", ValueError)])
def test_bad_templates_fail_on_the_driver(spark, template, error):
    df = spark.createDataFrame([("a", "b", "c")], SCHEMA)
    with pytest.raises(error):
        InstructionFormatter("instruction", "output", "input", template).columns(df)


def test_non_string_fields(spark):
    schema = "instruction int, input boolean, output bigint"
    with pytest.raises(TypeError):
        formatted(spark, [(1, True, 2)], DEFAULT, schema)
    cast = InstructionFormatter("instruction", "output", "input", cast_non_string=True)
    got = formatted(spark, [(1, True, 2), (0, False, None)], cast, schema)
    assert got == [("Instruction: 1\nInput: True\n\nResponse:", "2"), ("Instruction: 0\n\nResponse:", "None")]


def test_row_formatter_matches_column_formatter(spark):
    def fn(row):
        extra = row.get("input")
        block = f"\nInput: {extra}" if extra else ""
        return f"Instruction: {row.get('instruction', '')}{block}\n\nResponse:", row.get("output", "")

    rows = [("do", "x", "y"), ("do", "", "y"), (None, None, None), ("é$", " ", "ü")]
    assert formatted(spark, rows, RowFormatter(fn, ("instruction", "input", "output", "absent"))) == formatted(spark, rows, DEFAULT)


def test_row_formatter_without_known_fields(spark):
    got = formatted(spark, [("a", "b", "c")] * 3, RowFormatter(lambda row: ("p", str(len(row))), ("absent",)))
    assert got == [("p", "0")] * 3


def test_row_formatter_sees_python_values(spark):
    df = spark.createDataFrame([(1, None), (None, [1, 2])], "n int, xs array<int>")
    got = with_prompt_target(df, RowFormatter(lambda row: (repr(row["n"]), repr(row["xs"])), ("n", "xs")))
    assert [(r.prompt, r.target) for r in got.collect()] == [("1", "None"), ("None", "[1, 2]")]


def test_row_formatter_null_target_prints_as_none(spark):
    assert formatted(spark, [("a", "b", None)], RowFormatter(lambda row: ("p", row["output"]), ("output",))) == [("p", "None")]


def test_full_text_joins_with_one_space(spark):
    df = spark.createDataFrame([("", "")], "p string, t string")
    assert df.select(full_text(F.col("p"), F.col("t")).alias("x")).first().x == " "


def test_formatting_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("a", "b", "c")], SCHEMA)
    assert "Python" not in plan_of(with_prompt_target(df, DEFAULT).select("prompt", "target"))
