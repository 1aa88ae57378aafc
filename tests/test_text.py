import pytest
from pyspark.sql import functions as F

from citeflow.functions import (
    collapse_ws,
    conversation,
    first_nonempty,
    keep_last_words,
    l2_normalise,
    parse_name_list,
    preview,
    render_chat,
    split_judges,
    strip_ws,
    tag_format,
    word_count,
    words,
)
from citeflow.functions.chat import ChatTemplate
from citeflow.functions.names import field_or_name, json_or, match_count

SPACES = ["a\tb\nc", "  a  b ", "\xa0a\u0085b c\x1cd", "a​b", "", " \t\n", None, "\x1d\x1e\x1fx　", "one"]


def test_collapse_is_split_and_join(values):
    assert values(collapse_ws, SPACES) == [None if s is None else " ".join(s.split()) for s in SPACES]


def test_strip(values):
    assert values(strip_ws, SPACES) == [None if s is None else s.strip() for s in SPACES]


def test_words_and_counts(values):
    assert values(word_count, SPACES) == [None if s is None else len(s.split()) for s in SPACES]
    assert values(words, SPACES) == [None if s is None else s.split() for s in SPACES]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_last_words(values, n):
    got = values(lambda c: keep_last_words(c, n), SPACES[:6])
    assert got == [" ".join(s.split()[-n:]) for s in SPACES[:6]]


def test_preview_counts_characters(values):
    assert values(lambda c: preview(c, 2), ["éàü", "a", None]) == ["éà", "a", None]


def test_name_lists(values):
    cases = {
        "['A', 'B']": ["A", "B"],
        "[\"O'Brien\", 'Smith']": ["O'Brien", "Smith"],
        "[]": [],
        "Smith": ["Smith"],
        "('A', 'B')": ["A", "B"],
        "('A',)": ["A"],
        "['A',]": ["A"],
        "[1, 2]": ["1", "2"],
        "'A'": ["A"],
        "123": ["123"],
        "[' A ', '']": ["A"],
        "[broken": ["[broken"],
        "(Smith)": ["(Smith)"],
        "  ": [],
        None: [],
        " ['A'] ": ["A"],
        "'A', 'B'": ["A", "B"],
        "'A',": ["A"],
        "'A, B', \"C\"": ["A, B", "C"],
        "['A', None]": ["A", "None"],
        "[None]": ["None"],
        "None": ["None"],
        "[True, 'x']": ["True", "x"],
        "['a, None, b', ' ', 'c']": ["a, None, b", "c"],
        "['A' 'B']": ["AB"],
        "['A'\n 'B']": ["AB"],
        "[' ', 'x']": ["x"],
        "['\\x41b']": ["Ab"],
        "['\\\\x41b']": ["\\x41b"],
    }
    assert values(parse_name_list, list(cases)) == list(cases.values())


def test_split_judges(values):
    assert values(split_judges, ["A, B,,", " ", "A"]) == [["A", "B"], [], ["A"]]


def test_first_nonempty(spark):
    df = spark.createDataFrame([("", "b"), ("a", "b"), (None, "b"), (None, "")], "x string, y string")
    assert [r.z for r in df.select(first_nonempty(F.col("x"), F.col("y")).alias("z")).collect()] == ["b", "a", "b", None]


def test_json_fields(values):
    bodies = ['{"a":"","b":"x"}', '{"a":[],"b":["y"]}', '{"a":0,"b":5}', "{}", None]
    assert values(lambda c: json_or(c, "a", "b"), bodies) == ["x", '["y"]', "5", None, None]
    courts = ['{"court":{"name":"C"}}', '{"court":"D"}', '{"court":{}}', "{}"]
    assert values(lambda c: field_or_name(c, "court"), courts) == ["C", "D", None, None]


def test_match_count(values):
    assert values(match_count, ["[1,2]", "[]", '{"a":1}', "oops", None]) == [2, 0, 1, 0, 0]


def test_tags_with_missing_value(values):
    assert values(lambda c: tag_format([("A", c), ("B", F.lit("x"))]), ["v", None]) == ["<A>v</A> <B>x</B>", "<A></A> <B>x</B>"]


def test_zero_vector_stays_zero(values):
    got = values(l2_normalise, [[3.0, 4.0], [0.0, 0.0]], "array<float>")
    assert got[1] == [0.0, 0.0]
    assert got[0] == pytest.approx([0.6, 0.8])


def test_evaluation_prompt_hides_the_answer(spark):
    df = spark.range(1).select(conversation(F.lit("ask"), F.lit("secret")).alias("m"))
    template = ChatTemplate("[{role}]", "|")
    full, shown = df.select(
        render_chat(F.col("m"), template).alias("a"), render_chat(F.col("m"), template, generation=True).alias("b")
    ).first()
    assert full == "[user]ask|[assistant]secret|"
    assert shown == "[user]ask|[assistant]"
