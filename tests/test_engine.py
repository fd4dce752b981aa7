import itertools

import pytest

from lectern.engine import Engine, Request, RequestError


@pytest.fixture(scope="module")
def engine(spark, sf):
    return Engine(spark, sf, common_words=frozenset({"the", "of"}))


@pytest.fixture(scope="module")
def modules(engine):
    return [r.module for r in engine.table("verses").groupBy("module").count().orderBy("count", ascending=False).limit(2).collect()]


def test_option_matrix_plans(engine, modules):
    """Every combination of options gives a plan; nothing runs."""
    flags = ["whole_words", "exact_case", "highlight", "page_all", "context"]
    for values in itertools.product((False, True), repeat=len(flags)):
        for kind, text in (("and", "king lamp"), ("boolean", "king PROX(3) (lamp || cup)"), ("phrase", "silver cup"), ("proximity", "king lamp")):
            engine.query(Request(modules[:1], search=text, search_type=kind, **dict(zip(flags, values)))).schema


def test_lookup_and_search(engine, modules):
    a = engine.query(Request(modules[:1], reference="1B 1:1-3")).collect()
    assert all((r.book, r.chapter) == (1, 1) and r.verse <= 3 for r in a)
    both = engine.query(Request(modules, search="a", page_all=True))
    rows = both.collect()
    assert rows and [(r.book, r.chapter, r.verse) for r in rows] == sorted((r.book, r.chapter, r.verse) for r in rows)
    assert engine.paging(Request(modules, search="a")).first().total == engine.hits(Request(modules, search="a")).count()
    assert engine.result_list(Request(modules, search="a")).count() > 0
    assert engine.by_passage(Request(modules, reference="1B 1; 2B 1")).columns[0] == "passage"
    assert engine.statistics("1B 1:1-5", modules).count() > 0
    assert engine.editions().count() > 0 and engine.books("en", modules[0]).count() == 66 and engine.changed().first()[0]


def test_actions_and_replay(engine, modules):
    r = Request(modules[:1], search="a", page=3)
    key, text = engine.cached(r)
    assert key == engine.cached(Request(modules[:1], search="a"))[0] and '"page"' not in text
    assert engine.replay(text, 1).columns == engine.query(r).columns
    assert engine.action("bibles").count() > 0 and engine.action("shortcuts", lang_="en").count() > 0
    for bad in ({"name": "nothing"}, {"name": "bibles", "allowed": frozenset()}):
        with pytest.raises(RequestError):
            engine.action(**bad)
    assert sum(r.found for r in engine.self_test(modules[0], ["1B - 66B", "2B 1:1"]).collect()) > 0
    name = engine.table("books").where("lang = 'en' and id = 1").first().name
    assert engine.disambiguation(name[:4]).first().id == 1
    assert engine._route(Request(modules, request=f"{name} 3"))[0] and engine._route(Request(modules, request="lamp"))[1]
    assert engine._route(Request(modules, request=f"{name} 3", search="lamp")) == (f"{name} 3", "lamp")
    assert engine._route(Request(modules, request="lamp", reference="1B 1")) == ("1B 1", "lamp")


def test_refusals(engine, modules):
    for bad in (Request(modules), Request(modules, request="x", search="y", reference="1B 1"), Request(modules, reference="Nowhere 3"), Request(modules, search="the of")):
        with pytest.raises(ValueError):
            engine.query(bad)
    with pytest.raises(RequestError):
        engine.passages("Nowhere 3", "en")


def test_book_by_a_later_word(engine):
    long = next(r for r in engine.table("books").where("lang = 'en' and name like '% of %'").orderBy("id").collect())
    found = engine.passages(f"{long.name.split()[-1]} 2:3; 1B 1", "en")
    assert [p.book for p in found] == [long.id, 1] and found[0].items[0].bounds() == (2003, 2003)
    with pytest.raises(RequestError):
        engine.passages("qqqqq 1", "en")


def test_accented_hits_are_marked(engine):
    module = engine.units.where("lower(text) like '%épi%'").select("module").first()
    if module is None:
        pytest.skip("no accented hit in these tables")
    rows = engine.query(Request([module[0]], search="epi", highlight=True, page_all=True)).collect()
    assert any("<b>épi</b>" in r.text.lower() for r in rows) and all("<b>" in r.text for r in rows)


def test_ids_and_random_places(engine, modules):
    first = engine.units.where((engine.units.module == modules[0]) & (engine.units.id == 3)).first()
    rows = engine.query(Request(modules[:1], reference="3V")).collect()
    assert [(r.book, r.chapter, r.verse) for r in rows] == [(first.book, first.chapter, first.verse)]
    for kind in ("Book", "Chapter", "verse"):
        a, b = (engine.hits(Request(modules[:1], reference=f"Random {kind}", seed=5)).select("id").collect() for _ in "ab")
        assert a and sorted(a) == sorted(b)
    assert len(engine.hits(Request(modules[:1], request="random_verse", seed=1)).collect()) >= 1
    with pytest.raises(RequestError):
        engine.hits(Request(["nowhere"], reference="Random Book"))


def test_passage_results(engine, modules):
    rows = engine.action("passages", r=Request(modules, reference="1B 1:1; 1B 1; 66B 99")).orderBy("passage").collect()
    assert rows[0].single_verse and rows[0].nav is None and rows[1].nav.pcb is None and rows[1].nav.nb == 2
    assert rows[1].verses_count == max((len(v) for v in (rows[1].verses or {}).values()), default=0)
    assert rows[2].verses is None and rows[2].chapter_verse is None and rows[2].verses_count == 0
    lean = engine.passage_results(Request(modules, reference="1B 1"), verbose=False).first()
    assert lean.nav.next_book is None and lean.nav.nb == 2


def test_common_words_by_language(spark, sf, modules):
    own = Engine(spark, sf, common_words={"en": frozenset({"lamp"}), "fr": frozenset({"roi"})})
    with pytest.raises(ValueError):
        own.query(Request(modules[:1], search="lamp"))
    with pytest.raises(ValueError):
        own.query(Request(modules[:1], search="roi", lang="en,fr"))
    own.query(Request(modules[:1], search="roi"))


def test_languages_of_editions(spark, sf, engine):
    of = {}
    for r in engine.table("bibles").where("lang_short is not null").orderBy("id").collect():
        of.setdefault(r.lang_short, r.module)
    pair = list(of.values())[:2]
    for kind, refused in (("and", False), ("boolean", False), ("regexp", False), ("proximity", True), ("chapter", True), ("book", True)):
        if refused:
            with pytest.raises(RequestError):
                engine.hits(Request(pair, search="king lamp", search_type=kind))
        else:
            engine.hits(Request(pair, search="king", search_type=kind))


def test_storage_asks_for_a_shared_folder(monkeypatch):
    from lectern import storage

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://x:7077"
        getConf = staticmethod(lambda: Conf())

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session())


def test_shortcuts_with_any_separator(spark):
    from lectern.operators import catalog
    from lectern.plans import refs

    rows = spark.createDataFrame([(1, "en", "The Cup", "cup", None, "", "1B 2:3 | 2B 1-3 and '3B 4:1,5'"), (2, "en", "Other", "cup", None, None, "9B 1")], "id int, lang string, name string, short1 string, short2 string, short3 string, reference string")
    known = catalog.shortcut_map(rows, "en")
    assert set(known) == {"the cup", "cup", "other"}
    found = refs.parse_references("Cup", lambda b: int(b[:-1]) if b.endswith("B") else None, known)
    assert [(p.book, p.items[0].c0) for p in found] == [(1, 2), (2, 1), (3, 4)]
