"""Registered queries of the core operators and the SQL that checks them.

Every query reads its whole tables.  Queries on page markup that no table
holds run over literal rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import html as H
from gridloom.functions import text as T
from gridloom.functions import values as V
from gridloom.functions import wiki as W
from gridloom.operators import enrich, frontier, rank
from gridloom.operators.index import Index, documents, field_stats, postings, term_stats
from gridloom.operators.multivalue import split_values
from gridloom.plans import search as S
from gridloom.plans.query import BOOSTS, parse
from gridloom.sources import readers
from gridloom.sources.tables import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


# --- shared SQL ---------------------------------------------------------------------------------------------------

SPACE = r"[ \t\n\r\f\x0B\x{{A0}}]+"  # braces doubled for str.format


def sql_tokens(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+'))"


TF = f"tf as (select term, doc_id, count(*) as tf from (select doc_id, unnest({sql_tokens('text')}) as term from documents) group by all)"
STAT = "stat as (select term, count(*) as df from tf group by term), size as (select count(*) as n from documents)"
CLASSIC = "case when df > 0 then ln(n / df::double) else 0 end"
PROB = "case when df > 0 and df < n then ln((n - df) / df::double) else 0 end"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


# --- term statistics and TF-IDF -----------------------------------------------------------------------------------


@query(f"select doc_id, len({sql_tokens('text')})::bigint as n_tokens from documents")
def tokenize_count(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.size(T.tokens("text")).cast("bigint").alias("n_tokens"))


@query(f"with {TF} select term, doc_id, tf::bigint as tf from tf")
def term_freq(spark: SparkSession, sf: str) -> DataFrame:
    return rank.term_frequency(docs(spark, sf), "doc_id", "text")


@query(f"with {TF} select term, count(*) as df from tf group by term")
def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return rank.document_frequency(rank.term_frequency(docs(spark, sf), "doc_id", "text"))


@query("select count(*) as n from documents")
def corpus_size(spark: SparkSession, sf: str) -> DataFrame:
    return rank.corpus_size(docs(spark, sf))


def _idf(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = docs(spark, sf)
        return rank.inverse_document_frequency(rank.term_frequency(d, "doc_id", "text"), d, kind).select("term", "df", F.round("idf", 6).alias("idf"))

    return run


def _weights(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rank.weights(docs(spark, sf), "doc_id", "text", kind).select("term", "doc_id", "tf", F.round("weight", 4).alias("weight"))

    return run


for _kind, _expr in (("classic", CLASSIC), ("probabilistic", PROB)):
    query(f"with {TF}, {STAT} select term, df, round({_expr}, 6) as idf from stat, size", f"idf_{_kind}")(_idf(_kind))
    query(f"with {TF}, {STAT} select term, doc_id, tf::bigint as tf, round(tf * {_expr}, 4) as weight from tf join stat using (term), size", f"tfidf_weights_{_kind}")(_weights(_kind))

#: a query repeats a word, one has a word that no text holds, one has only common words
SAMPLE_QUERIES = ("grand prix driver named Peter", "gearbox gearbox fault", "british driver zzzz", "1987", "the last race of the season")

_RANKED = """
asked(q, query) as (values {values}),
wanted as (select q, query, unnest({words}) as term from asked),
tf as (select term, {key} as k, count(*) as tf from (select {key}, unnest({toks}) as term from {source}) where term in (select term from wanted) group by all),
stat as (select term, count(*) as df from tf group by term), size as (select count(*) as n from {source}),
w as (select q, query, 'classic' as variant, k, tf * {classic} as w from wanted join tf using (term) join stat using (term), size
      union all select q, query, 'probabilistic', k, tf * {prob} from wanted join tf using (term) join stat using (term), size),
s as (select q, query, variant, k, round(sum(w), 4) as score from w group by all),
r as (select *, row_number() over (partition by q, variant order by score desc, k) as rank from s)
"""


def _ranked_sql(source: str, key: str, text: str, queries: tuple[str, ...]) -> str:
    values = ", ".join(f"({i}, '{q}')" for i, q in enumerate(queries))
    return _RANKED.format(values=values, words=sql_tokens("query"), key=key, toks=sql_tokens(text), source=source, classic=CLASSIC, prob=PROB)


def _topk(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rank.rank(docs(spark, sf), "doc_id", "text", SAMPLE_QUERIES[:1], kinds=(kind,)).select("rank", "doc_id", "score")

    return run


for _kind in ("classic", "probabilistic"):
    query(f"with {_ranked_sql('documents', 'doc_id', 'text', SAMPLE_QUERIES[:1])} select rank::int as rank, k as doc_id, score from r where variant = '{_kind}' and rank <= 5", f"tfidf_topk_{_kind}")(_topk(_kind))


@query(f"with {_ranked_sql('documents', 'doc_id', 'text', SAMPLE_QUERIES)} select query, variant, rank::int as rank, k as doc_id, score from r where rank <= 5")
def batch_queries_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rank.rank(docs(spark, sf), "doc_id", "text", SAMPLE_QUERIES)


_RECORD = ("driver_name", "birth_date", "nationality", "teams", "starts", "wins", "poles", "podiums")
_ASSEMBLED = "concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in _RECORD) + ")"


def assembled(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "drivers_teams").dropDuplicates(["rec_id"])
    return rows.select("rec_id", F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in _RECORD)).alias("text"))


@query(f"select distinct rec_id, {_ASSEMBLED} as text from drivers_teams")
def document_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return assembled(spark, sf)


@query(f"with rec as (select distinct rec_id, {_ASSEMBLED} as text from drivers_teams), {_ranked_sql('rec', 'rec_id', 'text', SAMPLE_QUERIES)} select query, variant, rank::int as rank, k as rec_id, score from r where rank <= 5")
def record_queries_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rank.rank(assembled(spark, sf), "rec_id", "text", SAMPLE_QUERIES)


@query(
    f"with {_ranked_sql('documents', 'doc_id', 'text', SAMPLE_QUERIES[:1])}, top as (select * from r where variant = 'classic' and rank <= 5) select rank::int as rank, k as doc_id, score, coalesce(source, k::varchar) as shown from top left join (select distinct doc_id, source from documents) d on d.doc_id = k"
)
def hit_fetch(spark: SparkSession, sf: str) -> DataFrame:
    hits = QUERIES["tfidf_topk_classic"](spark, sf)
    stored = docs(spark, sf).select("doc_id", "source").distinct()
    return stored.join(F.broadcast(hits), "doc_id", "right").select("rank", "doc_id", "score", F.coalesce("source", F.col("doc_id").cast("string")).alias("shown"))  # five rows


# --- markup of entity pages ---------------------------------------------------------------------------------------

_SQL_STRIP = f"trim(regexp_replace(replace(replace(replace(regexp_replace({{x}}, '<[^>]+>', '', 'g'), '&amp;', '&'), '&nbsp;', ' '), '&quot;', '\"'), '{SPACE}', ' ', 'g'))"


@query(f"select page_id, {_SQL_STRIP.format(x='text')} as plain from (select distinct page_id, text from spark)")
def strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark").select("page_id", "text").distinct().select("page_id", T.strip_tags("text").alias("plain"))


_H1 = "(?s)<h1[^>]*>(.*?)</h1>"


@query(f"select page_id, coalesce({_SQL_STRIP.format(x=f'regexp_extract(text, {chr(39)}{_H1}{chr(39)}, 1)')}, '') as title from (select distinct page_id, text from spark)")
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark").select("page_id", "text").distinct().select("page_id", H.page_title("text").alias("title"))


_ROW = '<tr class="database-table__row">'
#: literal pages: all parts present; a nested section, a header row, short rows, repeated teams, several values; nothing
PAGES = (
    (1, '<h1 class="x hero__title y">Ann <b>One</b></h1><div class="database-data__head">Born</div> <div class="database-data__content">3 May 1970 Leeds</div><div class="database-data__head">Wins</div><div class="database-data__content">4</div>'
        '<div class="database-data__content database-data__icon"><img src="f.png" alt=" British "></div>'
        f'<section class="s" id="championship-seasons"><table>{_ROW}<td>1990</td><td><a href="/a">Alpha &amp; Co</a></td></tr>{_ROW}<td>1991</td><td>none</td></tr></table></section>'
        f'<section class="s" id="non-championship-races">{_ROW}<td>1</td><td>2</td><td>3</td><td><a>Beta</a></td></tr>{_ROW}<td>1</td><td>2</td></tr></section>'
        '<section class="s" id="teams"><table><tr><th><a>Head</a></th></tr><tr><td><a>Alpha &amp; Co</a></td></tr><tr><td><a>Gamma&nbsp;GP</a></td></tr></table></section>'),
    (2, '<H1>no</H1><h1>Plain  Title</h1><div class="database-data__head">born</div>\n<div class="database-data__content">1971</div><div class="database-data__head">Starts</div><div class="database-data__content">9</div><div class="database-data__head">STARTS</div><div class="database-data__content">12</div>'
        f'<section class="s" id="championship-seasons"><section id="in"></section>{_ROW}<td>1</td><td><a>Lost</a></td></tr></section>'),
    (3, ""),
    (4, None),
)


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "page_id int, html string")


_PAGE_VALUES = "pages(page_id, html) as (values " + ", ".join("({}, {})".format(i, "null" if h is None else "'" + h.replace("'", "''") + "'") for i, h in PAGES) + ")"
_HEAD_SQL = '<div[^>]*class="[^"]*database-data__head[^"]*"[^>]*>'
_CONT_SQL = r'</div>\s*<div[^>]*class="[^"]*database-data__content[^"]*"[^>]*>(.*?)</div>'


def _stat_sql(name: str) -> str:
    return f"coalesce({_SQL_STRIP.format(x=f'list_extract(regexp_extract_all(html, {chr(39)}(?is){_HEAD_SQL}{name}{_CONT_SQL}{chr(39)}, 1), -1)')}, '') as {name}"


@query(
    f"with {_PAGE_VALUES} select page_id, coalesce({_SQL_STRIP.format(x=f'''case when regexp_matches(html, '(?s)<h1[^>]*class=\"[^\"]*hero__title[^\"]*\"[^>]*>(.*?)</h1>') then regexp_extract(html, '(?s)<h1[^>]*class=\"[^\"]*hero__title[^\"]*\"[^>]*>(.*?)</h1>', 1) else regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) end''')}, '') as name, "
    f"coalesce(array_to_string(list_slice(string_split({_SQL_STRIP.format(x=f'''regexp_extract(html, '(?is){_HEAD_SQL}Born{_CONT_SQL}', 1)''')}, ' '), 1, 3), ' '), '') as birth_date, "
    "coalesce(trim(regexp_extract(html, '(?s)<div[^>]*class=\"[^\"]*database-data__content[^\"]*database-data__icon[^\"]*\"[^>]*>.*?<img[^>]*alt=\"([^\"]+)\"[^>]*>', 1)), '') as nationality, "
    + ", ".join(_stat_sql(s) for s in H.STATS)
    + " from pages"
)
def html_fields(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark).select("page_id", H.page_title("html").alias("name"), H.born("html").alias("birth_date"), H.nationality("html").alias("nationality"), *(H.stat("html", s).alias(s) for s in H.STATS))


def _section_sql(section: str, marked: bool, cell: int) -> str:
    row = '(?s)<tr[^>]*class="database-table__row"[^>]*>(.*?)</tr>' if marked else "(?s)<tr[^>]*>(.*?)</tr>"
    body = f"regexp_extract(html, '(?is)<section[^>]+id=\"{section}\"[^>]*>(.*?)</section>', 1)"
    rows = f"select page_id, '{section}' as section, unnest(regexp_extract_all({body}, '{row}', 1)) as r, generate_subscripts(regexp_extract_all({body}, '{row}', 1), 1) as i from pages"
    part = f"list_extract(regexp_extract_all(r, '(?s)<td[^>]*>(.*?)</td>', 1), {cell})" if cell else "case when r not like '%<th%' then r end"
    return f"select page_id, section, i, {_SQL_STRIP.format(x=f'regexp_extract({part}, {chr(39)}(?s)<a[^>]*>(.*?)</a>{chr(39)}, 1)')} as team from ({rows})"


@query(
    f"with {_PAGE_VALUES}, t as ({' union all '.join(_section_sql(*s) for s in H.TEAM_SECTIONS)}), u as (select page_id, team, min((case section when 'championship-seasons' then 0 when 'non-championship-races' then 1000 else 2000 end) + i) as o from t where team <> '' group by all) "
    "select p.page_id, coalesce(string_agg(team, '; ' order by o), '') as teams from pages p left join u on u.page_id = p.page_id where html is not null group by p.page_id"
)
def section_teams(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark).where("html is not null").select("page_id", F.array_join(H.teams("html"), "; ").alias("teams"))


_LABEL = '<div class="database-data__head">{}</div> <div class="database-data__content">'
#: pages built from all records: text and column in turn, a text last; nulls stand for nothing
DRIVER_PAGE = ('<h1 class="hero__title">', "driver_name", "</h1>" + _LABEL.format("Born"), "birth_date", '</div><div class="database-data__content database-data__icon"><img src="f.png" alt="', "nationality", '"></div>' + _LABEL.format("Starts"), "starts",
               "</div>" + _LABEL.format("Wins"), "wins", "</div>" + _LABEL.format("Poles"), "poles", "</div>" + _LABEL.format("Podiums"), "podiums", "</div>")
TEAM_PAGE = ('<section class="s" id="teams"><table><tr><th>Teams</th></tr><tr><td><a>', "teams", "</a></td></tr></table></section>")


def built_pages(spark: SparkSession, sf: str, name: str, key: str, parts: tuple[str, ...]) -> DataFrame:
    rows = table(spark, sf, name).select(key, *parts[1::2]).distinct()
    return rows.select(F.col(key).alias("page_id"), F.concat(*(F.coalesce(F.col(x), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts))).alias("html"))


def _built_sql(name: str, key: str, parts: tuple[str, ...]) -> str:
    html = " || ".join(f"coalesce({x}, '')" if i % 2 else f"'{x}'" for i, x in enumerate(parts))
    return f"pages as (select {key} as page_id, {html} as html from (select distinct {', '.join((key, *parts[1::2]))} from {name}))"


@query(ORACLE["html_fields"].replace(_PAGE_VALUES, _built_sql("drivers", "driver_id", DRIVER_PAGE)))
def driver_page_fields(spark: SparkSession, sf: str) -> DataFrame:
    html = built_pages(spark, sf, "drivers", "driver_id", DRIVER_PAGE)
    return html.select("page_id", H.page_title("html").alias("name"), H.born("html").alias("birth_date"), H.nationality("html").alias("nationality"), *(H.stat("html", s).alias(s) for s in H.STATS))


@query(ORACLE["section_teams"].replace(_PAGE_VALUES, _built_sql("drivers_teams", "rec_id", TEAM_PAGE)))
def driver_page_teams(spark: SparkSession, sf: str) -> DataFrame:
    return built_pages(spark, sf, "drivers_teams", "rec_id", TEAM_PAGE).select("page_id", F.array_join(H.teams("html"), "; ").alias("teams"))


BASE = "https://racedb.example/drivers/"


@query(f"select distinct listing, unnest(regexp_extract_all('<a href=\"' || url || '\">', '{BASE.replace('.', chr(92) + '.')}[a-z0-9\\-]+/')) as url from frontier")
def list_links(spark: SparkSession, sf: str) -> DataFrame:
    page = F.concat(F.lit('<a href="'), F.col("url"), F.lit('">'))
    return table(spark, sf, "frontier").select("listing", F.explode(H.links(page, BASE)).alias("url")).distinct()


@query(r"select link_id, case when p = '' then 'index' else replace(p, '/', '_') end || '.html' as page_name from (select distinct link_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*', ''), '^/+|/+$', '', 'g') as p from frontier)")
def url_to_filename(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "frontier").select("link_id", "url").distinct().select("link_id", H.file_name("url").alias("page_name"))


# --- frontier -----------------------------------------------------------------------------------------------------


def links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "frontier").select("link_id", "url", "visited")


@query("select url, link_id, visited from (select *, row_number() over (partition by url order by link_id) as n from frontier) where n = 1")
def frontier_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.dedup(links(spark, sf), "link_id")


_CUT = "2022-01-01"


@query(
    f"with old as (select url, visited from (select url, visited, row_number() over (partition by url order by link_id) as n from frontier where found_at < timestamp '{_CUT}') where n = 1) "
    f"select url, visited from old union all select url, false from (select distinct url from frontier where found_at >= timestamp '{_CUT}' and url is not null and url not in (select url from old)) order by url"
)
def frontier_merge(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "frontier")
    old = frontier.dedup(f.where(F.col("found_at") < F.to_timestamp(F.lit(_CUT))).select("link_id", "url", "visited"), "link_id")
    return frontier.merge_new(old, f.where(F.col("found_at") >= F.to_timestamp(F.lit(_CUT)))).orderBy("url")


@query("select distinct link_id, url from frontier where not coalesce(visited, false)")
def frontier_unvisited(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.unvisited(links(spark, sf)).select("link_id", "url").distinct()


@query(
    r"select distinct link_id, url from (select link_id, url, case when p = '' then 'index' else replace(p, '/', '_') end || '.html' as page from (select link_id, url, "
    r"regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*', ''), '^/+|/+$', '', 'g') as p from frontier where not coalesce(visited, false))) "
    r"where page is null or page not in (select driver_id from drivers where driver_id is not null)"
)
def frontier_to_fetch(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.to_fetch(links(spark, sf), table(spark, sf, "drivers"), "driver_id").select("link_id", "url").distinct()


@query("select url, bool_or(coalesce(visited, false)) as visited from frontier where url is not null group by url")
def frontier_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every link once, visited where any row says so."""
    f = table(spark, sf, "frontier")
    late = F.coalesce(F.col("found_at") >= F.to_timestamp(F.lit(_CUT)), F.lit(False))
    return frontier.merge_flags(f.where(~late), f.where(late))


@query("select count(*) as links, count(distinct url) as urls, count_if(coalesce(visited, false))::bigint as visited, count_if(not coalesce(visited, false))::bigint as open from frontier")
def frontier_counters(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.counters(links(spark, sf))


@query("select url || case when coalesce(visited, false) then ' VISITED' else '' end as line, count(*) as n from frontier group by all")
def frontier_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the link file, written and read back."""
    lines = frontier.format_lines(links(spark, sf))
    again = frontier.format_lines(frontier.parse_lines(lines))
    return again.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


# --- join and enrichment ------------------------------------------------------------------------------------------

_NORM = r"lower(regexp_replace({x}, '\s+\(.*\)$', ''))"
_ABOUT = "text is not null and regexp_matches(lower(text), '" + "|".join(W.KEYWORDS) + "')"


@query(f"select d.driver_id, s.page_id from (select distinct driver_id, driver_name from drivers) d join (select distinct page_id, title from spark) s on {_NORM.format(x='d.driver_name')} = {_NORM.format(x='s.title')}")
def norm_name_join(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "drivers").select("driver_id", "driver_name").distinct()
    b = table(spark, sf, "spark").select("page_id", "title").distinct()
    return enrich.join_by_name(a, b).select("driver_id", "page_id")


@query(f"select distinct page_id from spark where {_ABOUT}")
def keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark").where(W.about_racing("text")).select("page_id").distinct()


@query(f"select d.driver_id, d.driver_name, s.title from drivers d join spark s on {_NORM.format(x='d.driver_name')} = {_NORM.format(x='s.title')} where {_ABOUT}")
def join_and_filter(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "drivers").select("driver_id", "driver_name")
    return enrich.join_by_name(a, table(spark, sf, "spark").where(W.about_racing("text")).select("title")).select("driver_id", "driver_name", "title")


def _clean_sql(x: str) -> str:
    for pattern, into in ((r"\[\[([^|\]]+)\|([^\]]+)\]\]", r"\2"), (r"\[\[([^\]]+)\]\]", r"\1"), (r"\{\{[^{}]+\}\}", ""), ("(?s)<.*?>", "")):
        x = f"regexp_replace({x}, '{pattern}', '{into}', 'g')"
    return f"coalesce(trim(regexp_replace(replace({x}, '|', ' '), '{SPACE.format()}', ' ', 'g')), '')"
_CLEANED = ("teams_wiki", "birth_place_wiki", "nationality_wiki", "wins_wiki")


@query("select distinct page_id, " + ", ".join(f"{_clean_sql(c)} as {c}" for c in _CLEANED) + " from spark")
def clean_value(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark").select("page_id", *(W.clean_value(c).alias(c) for c in _CLEANED)).distinct()


_DATE = r"(\d{4})[^0-9A-Za-z]{1,3}(\d{1,2})[^0-9A-Za-z]{1,3}(\d{1,2})(?:\D|$)"
_ISO = f"regexp_extract(birth_date_wiki, '{_DATE}', 1) || '-' || lpad(regexp_extract(birth_date_wiki, '{_DATE}', 2), 2, '0') || '-' || lpad(regexp_extract(birth_date_wiki, '{_DATE}', 3), 2, '0')"


@query(f"select distinct page_id, coalesce(case when regexp_matches(birth_date_wiki, '{_DATE}') and try_strptime({_ISO}, '%Y-%m-%d') is not null then {_ISO} end, {_clean_sql('birth_date_wiki')}) as birth_date from spark")
def clean_birth_date(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark").select("page_id", W.clean_birth_date("birth_date_wiki").alias("birth_date")).distinct()


@query("select distinct page_id, " + ", ".join(f"nullif(regexp_extract({_clean_sql(c)}, '([0-9]+)', 1), '') as {c}" for c in W.NUMBER_FIELDS) + " from spark")
def first_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark").select("page_id", *(W.first_number(W.clean_value(c)).alias(c) for c in W.NUMBER_FIELDS)).distinct()


def _ascii_sql(x: str) -> str:
    for pattern, into in W.ASCII_STEPS:
        x = f"regexp_replace({x}, '{pattern}', '{into}', 'g')"
    return x


#: (page_id, t): the articles' texts with plain letters, templates removed until none is left
_BARE = (
    f"bare0 as (select page_id, {_ascii_sql('text')} as t from (select distinct page_id, text from spark)), "
    f"bare1 as (select page_id, t from bare0 union all select page_id, regexp_replace(t, '{W.TEMPLATE}', '', 'g') from bare1 where regexp_matches(t, '{W.TEMPLATE}')), "
    f"bare as (select * from bare1 where t is null or not regexp_matches(t, '{W.TEMPLATE}'))"
)


def _bio_sql(x: str) -> str:
    for pattern, into in W.BIOGRAPHY_STEPS:
        x = "regexp_replace({}, '{}', '{}', 'g')".format(x, pattern.replace("'", "''"), into.replace("$", "\\"))
    return x


_WORDS_SQL = "array_to_string(list_slice(list_filter(regexp_extract_all({x}, '" + W.WORD.replace("'", "''") + "'), lambda w: len(w) >= 2), 1, 1000), ' ')"


@query(f"with recursive {_BARE} select page_id, coalesce({_WORDS_SQL.format(x=_bio_sql('t'))}, '') as first_1000_words from bare")
def biography(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark").select("page_id", "text").distinct().select("page_id", W.biography("text").alias("first_1000_words"))


#: (page_id, box): the braces are counted by a running sum over the pieces between them; (page_id, k, v): the last line of each name
_BOXES = (
    r"rest as (select page_id, regexp_replace(regexp_extract(text, '(?is)\{\{Infobox.*$'), '(?s)\n={2,}[^\n]*?={2,}.*$', '') as t from (select distinct page_id, text from spark)), "
    r"piece as (select page_id, unnest(p) as x, generate_subscripts(p, 1) as i from (select page_id, regexp_extract_all(t, '(?s)\{\{|\}\}|[^{}]+|[{}]') as p from rest)), "
    "deep as (select *, sum(case x when '{{' then 1 when '}}' then -1 else 0 end) over (partition by page_id order by i) as d from piece), "
    "stop as (select page_id, min(i) as n from deep where d = 0 group by page_id), "
    "box as (select page_id, string_agg(x, '' order by i) as box from deep left join stop using (page_id) where n is null or i <= n group by page_id), "
    f"line as (select page_id, unnest(regexp_extract_all(box, '{W.BOX_LINE}', 1)) as k, unnest(regexp_extract_all(box, '{W.BOX_LINE}', 2)) as v, generate_subscripts(regexp_extract_all(box, '{W.BOX_LINE}', 1), 1) as i from box), "
    "named as (select page_id, lower(trim(k)) as k, arg_max(v, i) as v from line group by all)"
)
_RAW_FIELDS = ", ".join("coalesce(" + ", ".join(f"max(v) filter (k = '{a}')" for a in dict.fromkeys(x.lower() for x in aliases)) + f", '') as {n}" for n, aliases in W.FIELD_ALIASES.items())


@query(f"with {_BOXES} select page_id, length(any_value(box)) as box_chars, {_RAW_FIELDS} from box left join named using (page_id) group by page_id")
def infobox_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Data boxes and their fields."""
    rows = table(spark, sf, "spark").select("page_id", "text").dropDuplicates(["page_id"]).withColumn("box", F.explode(F.array(W.infobox("text")))).where("box <> ''")
    f = rows.withColumn("f", F.explode(F.array(W.fields("box"))))  # once, not once for each column
    return f.select("page_id", F.length("box").alias("box_chars"), *(W.field(F.col("f"), a).alias(n) for n, a in W.FIELD_ALIASES.items()))


def _cleaned_field(name: str) -> str:
    if name == "birth_date_wiki":
        return f"coalesce(case when regexp_matches(birth_date_wiki, '{_DATE}') and try_strptime({_ISO}, '%Y-%m-%d') is not null then {_ISO} end, {_clean_sql(name)}) as {name}"
    return f"nullif(regexp_extract({_clean_sql(name)}, '([0-9]+)', 1), '') as {name}" if name in W.NUMBER_FIELDS else f"{_clean_sql(name)} as {name}"


@query(
    f"with recursive {_BOXES}, {_BARE}, raw as (select p.page_id, title, {_RAW_FIELDS} from (select distinct page_id, title, text from spark) p left join named using (page_id) where {_ABOUT} group by p.page_id, title), "
    f"tidy as (select page_id, title, {', '.join(map(_cleaned_field, W.FIELD_ALIASES))} from raw), bio as (select page_id, coalesce({_WORDS_SQL.format(x=_bio_sql('t'))}, '') as first_1000_words from bare) "
    f"select d.*, tidy.* exclude (page_id), first_1000_words from (select distinct driver_id, driver_name, birth_date, nationality from drivers) d join tidy on {_NORM.format(x='driver_name')} = {_NORM.format(x='title')} join bio using (page_id)"
)
def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Drivers with the cleaned fields and the biography of the racing article of their name."""
    d = table(spark, sf, "drivers").select("driver_id", "driver_name", "birth_date", "nationality").dropDuplicates(["driver_id"])
    return enrich.enrich(d, table(spark, sf, "spark").dropDuplicates(["page_id"]))


@query(f"select doc_id, {_WORDS_SQL.format(x=_ascii_sql('text'))} as words from documents")
def first_words(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", W.first_words("text").alias("words"))


# --- typed values and index tables --------------------------------------------------------------------------------


def _blank(c: str) -> str:
    return f"case when length(trim({c})) > 0 then trim({c}) end"


def _int_sql(c: str) -> str:
    return rf"case when regexp_full_match(trim({c}), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trunc(try_cast(trim({c}) as double)) as int) end"


def _num_sql(wiki: str, base: str | None) -> str:
    return f"coalesce({_int_sql(wiki)}, {_int_sql(base)}, 0)" if base else f"coalesce({_int_sql(wiki)}, 0)"


_GG_NUM = {"wins": ("wins_wiki", "wins"), "podiums": ("podiums_wiki", "podiums"), "poles": ("pol_positions_wiki", "poles"), "starts": ("entries_wiki", "starts"), "fastest_laps": ("fastest_laps_wiki", None), "championships": ("championships_wiki", None)}
_GG = "gg as (select distinct * from final_gg)"


def final(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "final_gg").dropDuplicates(["driver_id"])


@query(f"with {_GG} select driver_id, coalesce({_blank('nationality_wiki')}, {_blank('nationality')}) as nationality, {_blank('birth_place_wiki')} as birth_place from gg")
def text_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    return final(spark, sf).select("driver_id", V.text_value("nationality_wiki", "nationality").alias("nationality"), T.blank_to_null("birth_place_wiki").alias("birth_place"))


@query(f"with {_GG} select driver_id, " + ", ".join(f"{_num_sql(w, b)} as {n}" for n, (w, b) in _GG_NUM.items()) + " from gg")
def numeric_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    return documents(final(spark, sf)).select(F.col("doc_key").alias("driver_id"), *_GG_NUM)


_V = "trim(coalesce(nullif(birth_date_wiki, ''), birth_date))"
_FIRST = rf"regexp_split_to_array({_V}, '\s+')[1]"
_TRY = lambda p, f: f"case when regexp_full_match({_FIRST}, '{p}') then try_strptime({_FIRST}, '{f}') end"
_BIRTH = (
    f"coalesce({_TRY('[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}', '%Y-%m-%d')}, {_TRY('[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}', '%Y/%m/%d')}, {_TRY('[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}', '%d-%m-%Y')}, {_TRY('[0-9]{4}', '%Y')}, "
    rf"try_strptime(nullif(regexp_extract({_V}, '\b((?:19|20)[0-9]{{2}})\b', 1), ''), '%Y'))"
)


@query(f"with {_GG} select driver_id, epoch({_BIRTH})::bigint as birth_epoch from gg")
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    return final(spark, sf).select("driver_id", F.unix_timestamp(V.birth_timestamp("birth_date_wiki", "birth_date")).alias("birth_epoch"))


@query(f"with {_GG} select driver_id, " + ", ".join(f"case when {_num_sql(w, b)} > 0 then {_num_sql(w, b)} || ' {n}' end as {n}_text" for n, (w, b) in _GG_NUM.items()) + " from gg")
def stat_text(spark: SparkSession, sf: str) -> DataFrame:
    return documents(final(spark, sf)).select(F.col("doc_key").alias("driver_id"), *(f"{n}_text" for n in _GG_NUM))


@query(f"with {_GG} select driver_id, 'title' as name, title as value from gg where title is not null and title <> ''")
def extra_columns(spark: SparkSession, sf: str) -> DataFrame:
    return documents(final(spark, sf)).select(F.col("doc_key").alias("driver_id"), F.explode("extras").alias("name", "value"))


def _terms_sql(column: str, blanks: bool) -> str:
    return rf"list_filter(regexp_split_to_array(lower({column}), '\s+'), lambda w: w <> '')" if blanks else rf"regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}_]+')"


_FIELD_SQL = {
    "birth_place_wiki": _blank("birth_place_wiki"), "nationality_wiki": f"coalesce({_blank('nationality_wiki')}, {_blank('nationality')})", "driver_name": _blank("driver_name"), "teams_wiki": _blank("teams_wiki"),
    "car_number_wiki": _blank("car_number_wiki"), "birth_date_wiki": _blank("birth_date_wiki"), "birth_date": _blank("birth_date"), "biography": _blank("first_1000_words"),
    **{f"{n}_text": f"case when {_num_sql(w, b)} > 0 then {_num_sql(w, b)} || ' {n}' end" for n, (w, b) in _GG_NUM.items()},
}
_TERMS = " union all ".join(f"select driver_id, '{f}' as field, {_terms_sql(e, f in ('birth_date', 'birth_date_wiki'))} as terms from gg" for f, e in _FIELD_SQL.items())
_POST = f"{_GG}, fields as ({_TERMS}), posting as (select field, term, driver_id, count(*) as tf, any_value(dl) as dl from (select driver_id, field, len(terms) as dl, unnest(terms) as term from fields) group by all)"
_FSTAT = "fstat as (select field, count(*) as n_docs, avg(dl) as avgdl from (select field, driver_id, sum(tf) as dl from posting group by all) group by field), tstat as (select field, term, count(*) as df from posting group by all)"


@query(f"with {_POST} select field, term, driver_id as doc_key, tf::bigint as tf, dl::int as dl from posting")
def index_postings(spark: SparkSession, sf: str) -> DataFrame:
    return postings(documents(final(spark, sf)))


@query(f"with {_POST}, {_FSTAT} select field, n_docs, round(avgdl, 6) as avgdl from fstat")
def index_field_stats(spark: SparkSession, sf: str) -> DataFrame:
    return field_stats(postings(documents(final(spark, sf)))).select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"with {_POST}, {_FSTAT} select field, term, df from tstat")
def index_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return term_stats(postings(documents(final(spark, sf))))


# --- search -------------------------------------------------------------------------------------------------------


def _range_query(text: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return S.matches(Index.of(final(spark, sf)), parse(text)).select("doc_key", "score")

    return run


for _name, _text, _low, _high in (("ge", "wins>=2", 2, 999999), ("gt", "wins > 2", 3, 999999), ("le", "wins<=2", 0, 2), ("lt", "wins<2", 0, 1), ("eq", "wins==2", 2, 2), ("single_eq", "WINS = 2", 2, 2)):
    query(f"with {_GG} select driver_id as doc_key, 1.0::double as score from gg where {_num_sql('wins_wiki', 'wins')} between {_low} and {_high}", f"range_filter_{_name}")(_range_query(_text))


def _search_sql(words: list[str], k: int | None, need: int = 1, ranges: str = "", n_ranges: int = 0, fuzzy: bool = False) -> str:
    pairs = ", ".join(f"({i}, '{f}', '{w}', {b}, {1 if len(w) < 5 else 2})" for i, w in enumerate(words) for f, b in BOOSTS.items() if f in _FIELD_SQL)
    if fuzzy:
        match = (
            "near as (select w, t.field, term, df, boost, length(term) as lt, length(word) as lw, damerau_levenshtein(term, word) as d, most from tstat t join want on t.field = want.field where abs(length(term) - length(word)) <= most and damerau_levenshtein(term, word) <= most), "
            "best as (select *, boost * (1 - d / least(lt, lw)::double) as factor, row_number() over (partition by w, field order by d, term) as n from near where 1 - d / least(lt, lw)::double > 0), "
            "words as (select w, field, term, df, factor from best where n <= 50)"
        )
    else:
        match = "words as (select w, t.field, term, df, boost as factor from tstat t join want on t.field = want.field and t.term = want.word)"
    top = f"where rank <= {k}" if k else ""
    return (
        f"with {_POST}, {_FSTAT}, want(w, field, word, boost, most) as (values {pairs}), {match}, "
        "hit as (select driver_id, w, sum(factor * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as s from posting join words using (field, term) join fstat using (field) group by all), "
        f"total as (select driver_id, sum(s) + {n_ranges} as score, count(*) as n from hit group by driver_id having count(*) >= {need}), "
        f"r as (select driver_id, round(score, 4) as score, row_number() over (order by round(score, 4) desc, driver_id) as rank from total join gg using (driver_id) {ranges}) "
        f"select rank::int as rank, driver_id as doc_key, score from r {top}"
    )


def _search_query(text: str, use_or: bool = True, fuzzy: bool = False, k: int | None = 5) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = S.search(Index.of(final(spark, sf)), parse(text, use_or, fuzzy, k))
        return found.select("rank", "doc_key", F.round("score", 4).alias("score"))

    return run


query(_search_sql(["belgian", "racing"], 5), "search_exact_or")(_search_query("Belgian racing drivers"))
query(_search_sql(["grand", "prix"], 5, need=2), "search_exact_and")(_search_query("the Grand Prix", use_or=False))
query(_search_sql(["2", "wins"], 5), "search_stat_text")(_search_query("2 wins"))
query(_search_sql(["british"], 5, ranges=f"where {_num_sql('wins_wiki', 'wins')} between 1 and 999999", n_ranges=1), "search_words_and_range")(_search_query("British wins>0"))
query(_search_sql(["brittish", "sebatsian"], 5, fuzzy=True), "search_fuzzy")(_search_query("Brittish Sebatsian", fuzzy=True))


@query(f"with {_GG} select row_number() over (order by {_num_sql('wins_wiki', 'wins')} desc, driver_id)::int as rank, driver_id as doc_key, {_num_sql('wins_wiki', 'wins')} as wins from gg where {_num_sql('wins_wiki', 'wins')} >= 1 order by rank limit 5")
def sort_numeric_topk(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(Index.of(final(spark, sf)), parse("sort: wins wins>=1")).select("rank", "doc_key", "wins")


@query("select count(*) as hits from (" + _search_sql(["belgian", "racing"], None) + ")")
def search_total(spark: SparkSession, sf: str) -> DataFrame:
    return S.total_hits(Index.of(final(spark, sf)), parse("Belgian racing", fuzzy=False))


_MISSPELT = ("sebatsian", "gearbx", "brittish")
_WANT = ", ".join(f"({i}, '{f}', '{w}', {b}, {1 if len(w) < 5 else 2})" for i, w in enumerate(_MISSPELT) for f, b in BOOSTS.items() if f in _FIELD_SQL)


@query(
    # letters beyond ASCII become one byte each, as this distance counts bytes
    f"with {_POST}, {_FSTAT}, want(w, field, word, boost, most) as (values {_WANT}), flat as (select *, regexp_replace(term, '[^\\x00-\\x7F]', '_', 'g') as t from tstat), "
    "near as (select w, flat.field, term, boost, least(length(t), length(word)) as l, damerau_levenshtein(t, word) as d from flat join want on flat.field = want.field where abs(length(t) - length(word)) <= most and damerau_levenshtein(t, word) <= most), "
    "best as (select *, row_number() over (partition by w, field order by d, term) as n from near where d < l) select w, field, term, round(boost * (1 - d / l::double), 6) as factor from best where n <= 50"
)
def fuzzy_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms within the allowed edits of misspelt words, over the whole vocabulary."""
    index = Index.of(final(spark, sf))
    return S.word_terms(index, parse(" ".join(_MISSPELT), fuzzy=True)).select("w", "field", "term", F.round("factor", 6).alias("factor"))


def saved(spark: SparkSession, sf: str) -> Index:
    """The index of the table, written to the shared folder and read back."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    Index.of(final(spark, sf)).save(folder)
    return Index.load(spark, folder)


def _saved_query(text: str, fuzzy: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return S.search(saved(spark, sf), parse(text, fuzzy=fuzzy)).select("rank", "doc_key", F.round("score", 4).alias("score"))

    return run


query(ORACLE["search_exact_or"], "saved_search_exact")(_saved_query("Belgian racing drivers", False))
query(ORACLE["search_fuzzy"], "saved_search_fuzzy")(_saved_query("Brittish Sebatsian", True))


def _field_words(words: list[tuple[str, str, float]]) -> str:
    """SQL of a search for words in one field each, with their factors."""
    pairs = ", ".join(f"({i}, '{f}', '{w}', {b})" for i, (f, w, b) in enumerate(words))
    return (
        f"with {_POST}, {_FSTAT}, want(w, field, word, factor) as (values {pairs}), "
        "hit as (select driver_id, sum(factor * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as s from (select factor, t.field, term, df from want join tstat t on t.field = want.field and term = word) join posting using (field, term) join fstat using (field) group by all), "
        "r as (select driver_id as doc_key, round(s, 4) as score, row_number() over (order by round(s, 4) desc, driver_id) as rank from hit) select rank::int as rank, doc_key, score from r where rank <= 5"
    )


@query(_field_words([("nationality_wiki", "british", sum(BOOSTS.values())), ("biography", "kart", 2 * sum(BOOSTS.values()))]))
def search_field_grammar(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the exact grammar: a field, a factor, a sign for required, one for excluded alone."""
    found = S.search(Index.of(final(spark, sf)), parse("+nationality_wiki:British biography:kart^2 -italian", fuzzy=False))
    return found.select("rank", "doc_key", F.round("score", 4).alias("score"))


@query(f"with {_POST}, {_FSTAT} select field, count(*) as terms, sum(df)::bigint as postings, max(df) as most from tstat group by field")
def index_views(spark: SparkSession, sf: str) -> DataFrame:
    """The index asked in SQL, through its views."""
    Index.of(final(spark, sf)).register_views("index_views_")
    return spark.sql("select field, count(*) as terms, sum(df) as postings, max(df) as most from index_views_term_stats group by field")


@query(f"with {_POST}, {_FSTAT} select (select count(*) from gg) as documents, (select count(*) from posting) as postings, (select count(distinct term) from tstat) as terms")
def index_counters(spark: SparkSession, sf: str) -> DataFrame:
    return Index.of(final(spark, sf)).counters()


_PAGES_SQL = _built_sql("drivers", "driver_id", DRIVER_PAGE)


@query(f"with {_PAGES_SQL}, n as (select *, trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) as title from pages) select count(*) as files, count_if(title <> '')::bigint as saved, count_if(title = '')::bigint as rejected from n")
def page_counters(spark: SparkSession, sf: str) -> DataFrame:
    """How many built pages hold an entity and how many are put aside."""
    return readers.page_counters(built_pages(spark, sf, "drivers", "driver_id", DRIVER_PAGE).withColumnRenamed("page_id", "page_name"))


def _shown(default: str, *columns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in columns) + f", '{default}')"


_TEAMS = _shown("none", f"coalesce({_blank('teams_wiki')}, '')")


@query(
    f"with {_GG} select driver_id as doc_key, {_shown('Unknown', _blank('driver_name'))} as name, {_shown('unknown', _blank('birth_date_wiki'), _blank('birth_date'))} as birth, {_shown('unknown', _blank('birth_place_wiki'))} as place, "
    f"{_shown('unknown', _FIELD_SQL['nationality_wiki'])} as nationality, case when length({_TEAMS}) > 100 then {_TEAMS}[1:100] || '...' else {_TEAMS} end as teams, "
    + ", ".join(f"{_num_sql(*_GG_NUM[c])} as {c}" for c in ("wins", "podiums", "championships", "starts", "poles"))
    + " from gg"
)
def display_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return S.display(documents(final(spark, sf)))


# --- several values in one field ----------------------------------------------------------------------------------


@query()
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every team of drivers_teams.teams and spark.teams_wiki with its place in the order."""
    a = split_values(table(spark, sf, "drivers_teams"), "rec_id", "teams", "drivers_teams.teams")
    b = split_values(table(spark, sf, "spark"), "page_id", "teams_wiki", "spark.teams_wiki", wiki=True)
    return a.unionByName(b).select("field", "rec_id", "pos", "value")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The batch of sample queries over the documents, both variants."""
    return batch_queries_topk(spark, sf)


