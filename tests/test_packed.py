import pytest

from lectern.operators.packed import split_packed

CASES = {
    None: [],
    "": [],
    "  ": [],
    " , ; ": [],
    "Lok 57- ; ": ["Lok 57-"],
    "Lok 3,2 Vol 59": ["Lok 3", "2 Vol 59"],
    "Vit 41,42:36": ["Vit 41,42:36"],
    "a 1, 2; 3 and b 4 & c|d / e + f\tg\nh；i": ["a 1, 2; 3", "b 4", "c", "d", "e", "f", "g", "h", "i"],
    "1:2, 4\tVar 2": ["1:2, 4", "Var 2"],
    '"Ca ""Vi"" 46:39", Lo 10': ['Ca "Vi" 46:39', "Lo 10"],
    '"Le \\"Vi\\" 56"|Ti 5': ['Le "Vi" 56', "Ti 5"],
    "'Ca \"Vi\" 58'|'Ki'ne 1:18'|'Ke''ba 5'": ['Ca "Vi" 58', "Ki'ne 1:18", "Ke'ba 5"],
    "“Brev, Vi 3” + Ki'ne 60": ["Brev, Vi 3", "Ki'ne 60"],
    'Letters "Vi" 53:15': ['Letters "Vi" 53:15'],
    '"Rain and Ashes 5" and Vo 2': ["Rain and Ashes 5", "Vo 2"],
    '"unclosed 3, Vit 4': ['"unclosed 3', "Vit 4"],
    '"Vit 3:4", 5, 6; Lom 3': ["Vit 3:4, 5, 6", "Lom 3"],
    "''": [],
}


def test_cases(spark):
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(CASES)], "id long, t string, item string")
    got = split_packed(rows, "id", "t").orderBy("id", "item_no").collect()
    for k, t in enumerate(CASES):
        own = [r for r in got if r.id == k]
        assert [r.item for r in own] == CASES[t], t
        assert [r.item_no for r in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("text,n", [("x" * 200_000 + ", y", 2), ('"' + 'ab""' * 30_000 + '", z', 2), ("a 1;" * 5_000, 5_000), ("'" * 999, 1)])
def test_long(spark, text, n):
    assert split_packed(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").count() == n


def test_empty_and_repeated(spark):
    rows = spark.createDataFrame([(1, "a;b"), (1, "a;b")], "id long, t string")
    assert split_packed(rows, "id", "t").count() == 4
    assert split_packed(rows.limit(0), "id", "t").count() == 0
