import pytest

from lectern.plans.refs import Item, Passage, Ranges, exploded, is_reference, parse_references, parse_verses, split_references, with_context


def one(c, v=None):
    return Item(c, v, c, v, True)


CASES = {
    "2": [one(2)],
    "2:": [one(2)],
    "2:1": [one(2, 1)],
    "2:1-5": [Item(2, 1, 2, 5)],
    "2:1,4": [one(2, 1), one(2, 4)],
    "2:1-3:4": [Item(2, 1, 3, 4)],
    "2:-3:4": [Item(2, None, 3, 4)],
    "2-3:4": [Item(2, None, 3, 4)],
    "2:18-4:": [Item(2, 18, 4, None)],
    "14,3:4": [one(14), one(3, 4)],
    "14:,3:4": [one(14), one(3, 4)],
    "12:2 - :": [Item(12, 2, None, None)],
    "14-,3:4": [Item(14, None, None, None), one(3, 4)],
    "3:4,14:-": [one(3, 4), one(14)],
    "2:5 - 4:3, 7- 11": [Item(2, 5, 4, 3), Item(4, 7, 4, 11)],
    "25 - ": [Item(25, None, None, None)],
    "- 3": [Item(None, None, 3, None)],
    "- 3:8": [Item(None, None, 3, 8)],
    "12:2 - ": [Item(12, 2, 12, None)],
    "4:19 - 5": [Item(4, 19, 5, None)],
    "4:19 - 4": [Item(4, 19, 4, 4)],
    "1,4,6-8": [one(1), one(4), Item(6, None, 8, None)],
    "": [one(1)],
}


@pytest.mark.parametrize("text", CASES)
def test_verses(text):
    assert parse_verses(text) == CASES[text]


def resolve(name):
    return {"alpha": 1, "1 beta": 2, "songs of gamma": 3, "delta": 4, "zeta": 6}.get(name.lower())


def test_lists_of_books():
    got = parse_references("Alpha 3:4; 5:8, 1 Beta 2; Delta - Zeta", resolve)
    assert [(p.book, p.book_end, p.items) for p in got] == [(1, None, (one(3, 4), one(5, 8))), (2, None, (one(2),)), (4, 6, ())]
    assert parse_references("nobody 3", resolve)[0].book is None
    assert parse_references("", resolve) == []
    assert parse_references("shore", resolve, {"shore": "Alpha 1; Delta 2"})[1].book == 4
    assert parse_references("12V", lambda n: 9 if n == "9B" else None, verse_address=lambda i: (9, 1, i))[0].items == (one(1, 12),)


def test_bounds_and_shapes():
    assert Item(None, None, 3, 8).bounds() == (0, 3008)
    assert Item(12, 2, None, None).bounds() == (12002, 999999)
    assert with_context(Passage(1, (one(1, 3),)), 5).items == (Item(1, 1, 1, 8),)
    assert Ranges.of([Passage(4, (), 5), Passage(1, (one(2),))]).rows == [(1, 4, 0, 999999), (1, 5, 0, 999999), (2, 1, 2000, 2999)]
    parts = exploded(Passage(1, (Item(1, 5, 3, 2),)), lambda b: 9)
    assert [p.items[0] for p in parts] == [Item(1, 5, 1, None), Item(2, None, 2, None, True), Item(3, None, 3, 2)]
    assert split_references("1 Beta 2:3,4, Alpha 5") == [("1 Beta", "2:3,4"), ("Alpha", "5")]


def test_routing():
    assert is_reference("Alpha 3:4", resolve) and is_reference("Alpha; Delta", resolve)
    assert not is_reference("alpha", resolve) and not is_reference("Alpha 3 AND x", resolve) and not is_reference("faith 3", resolve)
