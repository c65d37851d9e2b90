import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridloom.operators import enrich, frontier, rank
from gridloom.operators.index import Index, documents
from gridloom.plans import search as S
from gridloom.plans.query import Console, EmptyQuery, Range, parse
from gridloom.sources import readers
from gridloom.streaming import crawl


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(1, "red red car"), (2, "blue car"), (3, ""), (4, None)], "k int, t string")


def test_idf_and_rank(spark, corpus):
    tf = rank.term_frequency(corpus, "k", "t")
    idf = {r["term"]: r["idf"] for r in rank.inverse_document_frequency(tf, corpus, "classic").collect()}
    assert idf["car"] == pytest.approx(math.log(4 / 2)) and idf["red"] == pytest.approx(math.log(4))
    prob = {r["term"]: r["idf"] for r in rank.inverse_document_frequency(tf, corpus, "probabilistic").collect()}
    assert prob["car"] == 0.0 and prob["red"] == pytest.approx(math.log(3))
    got = rank.rank(corpus, "k", "t", ["red", "red red", "nothing"], kinds=("classic",))
    assert rows(got, "query", "rank", "k", "score") == [("red red", 1, 1, round(4 * math.log(4), 4)), ("red", 1, 1, round(2 * math.log(4), 4))]


def test_frontier(spark, tmp_path):
    lines = spark.createDataFrame([("a VISITED",), ("b",), ("  ",), ("a",)], "value string")
    links = frontier.parse_lines(lines)
    assert rows(links) == [("a", False), ("a", True), ("b", False)]
    numbered = spark.createDataFrame([(1, "a", True), (2, "b", None), (3, "a", False)], "n int, url string, visited boolean")
    assert rows(frontier.dedup(numbered, "n")) == [("a", 1, True), ("b", 2, None)]
    merged = frontier.merge_new(links, spark.createDataFrame([("c",), ("c",), ("b",), (None,)], "url string"))
    assert rows(merged) == [("a", False), ("a", True), ("b", False), ("c", False)]
    assert rows(frontier.unvisited(numbered), "url") == [("a",), ("b",)]
    readers.write_links(links, str(tmp_path / "links"))
    assert rows(readers.read_links(spark, str(tmp_path / "links"))) == rows(links)
    assert readers.read_links(spark, str(tmp_path / "none")).count() == 0


def test_stream_of_links(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("a VISITED\nb\n")
    for more in ("b\nc\n", "c\nd\n"):
        crawl.merge_into(crawl.read_links(spark, str(folder)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        (folder / f"{len(more)}{more[0]}.txt").write_text(more)
    crawl.merge_into(crawl.read_links(spark, str(folder)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert {r["url"] for r in crawl.read_table(spark, str(tmp_path / "t")).collect()} == {"a", "b", "c", "d"}


def test_stream_keeps_flags_and_survives_a_crash(spark, tmp_path):
    folder, table, state = tmp_path / "in", tmp_path / "t", tmp_path / "c"
    folder.mkdir()

    def run(checkpoint=state):
        crawl.merge_into(crawl.read_links(spark, str(folder)), str(table), str(checkpoint)).awaitTermination()
        return rows(crawl.read_table(spark, str(table)))

    (folder / "1.txt").write_text("a VISITED\nb\nc\n")
    assert run() == [("a", True), ("b", False), ("c", False)]
    (folder / "2.txt").write_text("a\nb VISITED\n\n")
    assert run() == [("a", True), ("b", True), ("c", False)]
    last = crawl.versions(spark, str(table))[-1][1]
    (table / "v99-9-half").mkdir()  # written half when the process ended
    (table / "v99-9-half" / "part.parquet").write_text("x")
    assert rows(crawl.read_table(spark, str(table))) == [("a", True), ("b", True), ("c", False)]
    for commit in (state / "commits").iterdir():  # the last batch is run again
        if commit.name.strip(".").startswith(("1", "1.crc")) or commit.name == ".1.crc":
            commit.unlink()
    assert run() == [("a", True), ("b", True), ("c", False)] and crawl.versions(spark, str(table))[-1][1] == last
    (folder / "3.txt").write_text("d\n")
    assert run(tmp_path / "other") == [("a", True), ("b", True), ("c", False), ("d", False)]  # the stream's state was lost
    assert len(crawl.versions(spark, str(table))) == 2  # older versions are retired


def test_merge_flags(spark):
    old = spark.createDataFrame([("a", True), ("b", None), (None, True)], "url string, visited boolean")
    assert rows(frontier.merge_flags(old, spark.createDataFrame([("a", False), ("b", True), ("b", False), ("c", None)], "url string, visited boolean"))) == [("a", True), ("b", True), ("c", False)]


def test_links_with_queries_are_fetched(spark):
    links = spark.createDataFrame([("https://a/b/?x=1", None), ("https://a/c#t", False), ("https://a/d", True), ("https://a/e?f", False)], "url string, visited boolean")
    pages = spark.createDataFrame([("c.html",), (None,)], "page_name string")
    assert rows(frontier.to_fetch(links, pages), "url") == [("https://a/b/?x=1",), ("https://a/e?f",)]


def test_pages_put_aside_and_counted(spark):
    pages = spark.createDataFrame([("a", "<h1>A</h1>"), ("b", " "), ("c", None), ("d", "<p>x</p>")], "page_name string, html string")
    good, bad = readers.sorted_out(pages)
    assert rows(good, "page_name") == [("a",)] and rows(bad) == [("b", "empty"), ("c", "unread"), ("d", "no heading")]
    assert rows(readers.page_counters(pages)) == [(4, 1, 3)] and rows(readers.page_counters(pages.limit(0))) == [(0, 0, 0)]


def test_listing_of_several_pages():
    site = {"https://a/l": '<a rel="next" href="/l?p=2&amp;q">', "https://a/l?p=2&q": '<a class="x" rel="next" href="/l">', "https://a/m": '<a rel="next" href="n">'}
    assert [n for n, _ in readers.listing_pages("https://a/l", site.get)] == [1, 2] and [n for n, _ in readers.listing_pages("https://a/m", site.get)] == [1]
    assert list(readers.listing_pages("https://a/x", site.get)) == []


def test_fetch_tries_again(spark, tmp_path):
    def get(url):
        seen = tmp_path / "seen"
        first = not seen.exists()
        seen.write_text("x")
        return None if first else "page"

    got = readers.fetch(spark.createDataFrame([("https://a/b",)], "url string"), get=get, pause=0, tries=2)
    assert rows(got, "html", "ok") == [("page", True)]


def test_dump_of_both_forms(spark, tmp_path):
    (tmp_path / "w.xml").write_text('<m><page><title>T</title><revision><text bytes="3">abc</text></revision></page><page><title>U</title><revision><text>007</text></revision></page><page><title>V</title><revision><text>d e</text></revision></page><page><title>W</title></page></m>')
    assert rows(readers.read_wiki_xml(spark, str(tmp_path / "w.xml"))) == [("T", "abc"), ("U", "007"), ("V", "d e"), ("W", None)]


def test_checkpoint_folder():
    from gridloom.sources.tables import shared_folder

    class Session:
        def __init__(self, master, folder):
            self.sparkContext, self.conf = type("C", (), {"master": master})(), {"spark.checkpoint.dir": folder} if folder else {}

    assert shared_folder(Session("spark://x", "hdfs://y")) == "hdfs://y" and shared_folder(Session("local[2]", None))
    with pytest.raises(ValueError):
        shared_folder(Session("spark://x", None))


def test_pages_csv_xml_and_fetch(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.html").write_text("<h1>Ann</h1>")
    (tmp_path / "p" / "y.txt").write_text("<h1>Bob</h1>")
    got = readers.entities(readers.read_pages(spark, str(tmp_path / "p")))
    assert rows(got, "driver_id", "driver_name", "wins") == [("x.html", "Ann", "")]
    assert readers.read_pages(spark, str(tmp_path / "q")).count() == 0
    readers.write_csv(got, str(tmp_path / "csv"))
    assert rows(readers.read_csv(spark, str(tmp_path / "csv"), readers.ENTITY_SCHEMA), "driver_id", "driver_name") == [("x.html", "Ann")]
    (tmp_path / "w.xml").write_text('<m><page><title>T</title><revision><text bytes="3">abc</text></revision></page></m>')
    assert rows(readers.read_wiki_xml(spark, str(tmp_path / "w.xml"))) == [("T", "abc")]
    links = spark.createDataFrame([("https://a/b/",), ("https://a/c/",)], "url string")
    got = readers.fetch(links, get=lambda u: "page" if u.endswith("b/") else None, pause=0)
    assert rows(got, "page_name", "html", "ok") == [("b.html", "page", True), ("c.html", None, False)]


def test_enrich(spark):
    d = spark.createDataFrame([("1", "Ann One (driver)"), ("2", None)], "driver_id string, driver_name string")
    text = "{{Infobox\n| teams = [[A|B]]\n| wins = 1,234\n}}\nAnn is a racing driver [[File:x.jpg|thumb|Caption words]] from [[Leeds]].<ref>Note</ref>\n==Early life==\nBorn."
    w = spark.createDataFrame([("Ann one", text), ("Ann one (other)", "a cook"), (None, "racing driver")], "title string, text string")
    got = enrich.enrich(d, w).select("driver_id", "title", "teams_wiki", "wins_wiki", "first_1000_words").collect()
    assert [tuple(r) for r in got] == [("1", "Ann one", "B", "1", "Ann is racing driver from Leeds Born")]


@pytest.mark.parametrize(
    ("text", "ranges", "words"),
    [
        ("wins>8", [Range("wins", 9, 999999)], []), ("WINS >= 8 x", [Range("wins", 8, 999999)], ["x"]), ("wins<=3", [Range("wins", 0, 3)], []), ("wins<3", [Range("wins", 0, 2)], []), ("wins==3", [Range("wins", 3, 3)], []), ("wins = 3", [Range("wins", 3, 3)], []),
        ("wins>5 wins<10", [Range("wins", 6, 999999)], ["wins<10"]), ("wins>5 wins>7", [Range("wins", 6, 999999)], []), ("the driver wins>5", [Range("wins", 6, 999999)], []), ("starts>2 poles<5 Ann", [Range("poles", 0, 4), Range("starts", 3, 999999)], ["Ann"]),
    ],
)
def test_query_language(text, ranges, words):
    spec = parse(text)
    assert list(spec.ranges) == ranges and list(spec.words) == words


def test_query_language_edges():
    for text in ("driver", "the and", ""):
        with pytest.raises(EmptyQuery):
            parse(text)
    assert parse("sort:wins ann").sort_by == parse("sort: wins ann").sort_by == "wins" and parse("sort:age ann").sort_by is None
    c = Console()
    assert c.read("and") == "mode: and" and c.read(" ") is None and c.read("fuzzy off") == "fuzzy: off" and c.read("exit") == "exit" and not c.read("ann").use_or and not c.read("ann").fuzzy


@pytest.fixture(scope="module")
def index(spark):
    data = [("1", "Ann Peters", "Alpha Racing", "3", "ann drives fast"), ("2", "Bob Peters", "Beta", "0", "bob sleeps"), ("3", "Cal Petters", None, "x", None), ("1", "Ann Peters", "Alpha Racing", "3", "ann drives fast")]
    df = spark.createDataFrame(data, "driver_id string, driver_name string, teams_wiki string, wins string, first_1000_words string").withColumn("more", F.lit("m"))
    return Index.of(df)


def test_search(spark, index, tmp_path):
    keys = lambda spec: [r["doc_key"] for r in S.search(index, spec).orderBy("rank").collect()]
    assert keys(parse("peters", fuzzy=False)) == ["1", "2"] and set(keys(parse("peters"))) == {"1", "2", "3"}
    assert set(keys(parse("epters"))) == {"1", "2", "3"} and S.swapped("abc", 2)["bca"] == 2
    assert keys(parse("ann peters", use_or=False, fuzzy=False)) == ["1"] and keys(parse("sort: wins wins>=0")) == ["1", "2", "3"]
    assert keys(parse("3 wins", fuzzy=False))[0] == "1" and keys(parse("pet*", fuzzy=False)) and keys(parse("zzz", fuzzy=False)) == []
    assert S.total_hits(index, parse("peters wins>1", fuzzy=False)).first()["hits"] == 1
    assert set(keys(parse("ann alpha", use_or=False, fuzzy=False))) <= set(keys(parse("ann alpha", fuzzy=False)))
    index.save(str(tmp_path / "i"))
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    assert rows(S.search(again, parse("peters")), "rank", "doc_key") == rows(S.search(index, parse("peters")), "rank", "doc_key")
    assert rows(S.display(index.doc), "doc_key", "teams", "place", "wins") == [("1", "Alpha Racing", "unknown", 3), ("2", "Beta", "unknown", 0), ("3", "none", "unknown", 0)]


def test_exact_grammar(spark, index):
    keys = lambda text, **how: [r["doc_key"] for r in S.search(index, parse(text, fuzzy=False, **how)).orderBy("rank").collect()]
    assert keys("driver_name:peters") == ["1", "2"] and keys("teams_wiki:peters") == [] and keys("no_field:peters") == []
    assert keys("+peters -bob") == ["1", "2"] and keys("-peters") == [] and keys("peters !bob", use_or=False) == []
    assert keys("peterss~1") == ["1", "2"] and set(keys("peterss~")) == {"1", "2", "3"} and keys("pe?ers") == ["1", "2"]
    assert keys("ann bob^9") == ["2", "1"] and keys("ann^9 bob") == ["1", "2"] and keys('"ann') == keys("(ann)") == ["1"]


def test_pieces_lose_no_near_term():
    from gridloom.functions.editdist import osa

    words = ["petters", "pters", "peters", "petesr", "abc", "abd", "a", "", "gearbox", "gaerbxo"]
    for word in words:
        for most in (1, 2):
            for term in words:
                if osa(word, term) <= most:
                    near = [(v, n) for v, n in S.swapped(word, most).items()]
                    assert any(not (p := S.pieces(v, most - n)) or any(x in term for x in p) for v, n in near)


def test_views_and_counters(spark, index):
    index.register_views("t_")
    assert spark.sql("select sum(df) from t_term_stats where field = 'driver_name'").first()[0] == 6
    assert rows(index.counters(), "documents") == [(3,)]


def test_documents_keep_other_columns(index):
    assert index.doc.where("doc_key = '1'").first()["extras"] == {"more": "m"}
    assert documents(index.doc.limit(0).select(F.col("doc_key").alias("driver_id"))).count() == 0


def test_plans_read_what_they_need(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    saved = Index.load(spark, str(tmp_path / "i"))
    plan = S.matches(saved, parse("wins>=2")).select("doc_key")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(wins,2)" in plan and "ReadSchema: struct<doc_key:string,wins:int>" in plan
    plan = S.scores(saved, parse("peters", fuzzy=False))._jdf.queryExecution().toString()
    assert "PartitionFilters: [field" in plan and "EqualTo(term,peters)" in plan and "CartesianProduct" not in plan
    joined = enrich.join_by_name(spark.range(1).selectExpr("'a' as driver_name"), spark.range(1).selectExpr("'a (x)' as title"))
    assert joined.count() == 1
