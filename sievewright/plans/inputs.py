"""Inputs of the queries, composed from the driver's tables; the oracles compose the same texts in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reference_list
from ..session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(template: str, **columns: Column) -> Column:
    """A text with {name} places filled from columns."""
    out, rest = [], template
    while rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        out += [F.lit(before)] * bool(before) + ([columns[name].cast("string")] if name else [])
    return F.concat(*out)


def filled_sql(template: str, **columns: str) -> str:
    out, rest = [], template
    while rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        out += ["'" + before.replace("'", "''") + "'"] * bool(before) + ([f"({columns[name]})::VARCHAR"] if name else [])
    return "(" + " || ".join(out) + ")"


def by_case(number: Column, cases: list[Column]) -> Column:
    out = F.when(F.lit(False), cases[0])
    for i, c in enumerate(cases):
        out = out.when(number % len(cases) == i, c)
    return out


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s_suppkey with as_typed, a name as handles are written, as_handle, the same in lower case, and k, the key as text."""
    name = F.regexp_replace("s_name", "[^A-Za-z0-9]+", "_")
    return table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("as_typed"), F.lower(name).alias("as_handle"), F.col("s_suppkey").cast("string").alias("k"))


SUPPLIERS_SQL = "s AS (SELECT s_suppkey, regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g') AS H_, lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g')) AS h, s_suppkey::VARCHAR AS k FROM supplier)"
SQL_NAMES = {"H": "H_", "h": "h", "k": "k"}

DESCRIPTIONS = [
    "Канал https://t.me/{H} и страница https://vk.com/{H}.",
    "Аккаунт https://www.instagram.com/{H}/; сайт site-{k}.info, далее",
    "Чат, последовательность цифр 77{k}",
    "Профиль @{h} и https://ok.ru/group/4471{k}б31207",
    "Материал без адреса",
    "Ролик https://www.tiktok.com/@{H}/video/88{k}; зеркало {h}.info",
]
#: For each description its identifiers in order: platform, kind, value.
EXPECTED = [
    [("telegram", "handle", "{h}"), ("vk", "handle", "{h}")],
    [("instagram", "handle", "{h}"), ("web", "domain", "site-{k}.info")],
    [("telegram", "numeric_id", "77{k}")],
    [("ok", "numeric_id", "4471{k}631207"), ("ok", "numeric_id", "4471{k}31207"), ("telegram", "handle", "{h}")],
    [],
    [("tiktok", "handle", "{h}"), ("tiktok", "video", "88{k}")],
]


def list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with one row a supplier, a header row, and rows that are cancelled or offline by turns."""
    s = suppliers(spark, sf_dir)
    text = by_case(F.col("s_suppkey"), [filled(d, H=F.col("as_typed"), h=F.col("as_handle"), k=F.col("k")) for d in DESCRIPTIONS])
    text = F.concat(F.when(F.col("s_suppkey") % 13 == 0, F.lit("Книжное издание. ")).otherwise(""), text, F.when(F.col("s_suppkey") % 11 == 0, F.lit(" Отменено решением суда")).otherwise(""))
    rows = s.select(F.col("s_suppkey").cast("int").alias("row_index"), F.array(F.lit(" Материалы  в сети "), text, F.concat(F.lit("Суд "), "k")).alias("cells"))
    header = spark.range(1).select(F.lit(0).alias("row_index"), F.array(F.lit("Вид экстремистских материалов"), F.lit("Описание"), F.lit("Наименование суда")).alias("cells"))
    return header.unionByName(rows)


def reference(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries and identifiers of the composed list, made once and written, as a list is before it is matched."""
    entries = cut_lineage(reference_list.entries_of(list_cells(spark, sf_dir)))
    return entries, cut_lineage(reference_list.identifiers_of(entries))


def _identifiers_sql() -> str:
    parts = []
    for case, expected in enumerate(EXPECTED):
        for pos, (platform, kind, value) in enumerate(expected):
            parts.append(f"SELECT s_suppkey AS entry_id, {pos} AS ident_pos, '{platform}' AS platform, '{kind}' AS kind, {filled_sql(value, **SQL_NAMES)} AS value FROM s WHERE s_suppkey % {len(EXPECTED)} = {case} AND s_suppkey % 11 <> 0")
    return " UNION ALL ".join(parts)


_CASES = " ".join(f"WHEN {i} THEN {filled_sql(d, **SQL_NAMES)}" for i, d in enumerate(DESCRIPTIONS))
#: entries (e) and identifiers (i); ids follow the supplier key.
REFERENCE_SQL = f"""{SUPPLIERS_SQL},
e AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS id, s_suppkey::INTEGER AS row_index, 'Материалы в сети' AS material_type,
        CASE WHEN s_suppkey % 13 = 0 THEN 'Книжное издание. ' ELSE '' END || CASE s_suppkey % {len(DESCRIPTIONS)} {_CASES} END
        || CASE WHEN s_suppkey % 11 = 0 THEN ' Отменено решением суда' ELSE '' END AS description, 'Суд ' || k AS court,
        s_suppkey % 11 = 0 AS is_cancelled, s_suppkey % 13 = 0 AS is_offline, s_suppkey FROM s),
i0 AS ({_identifiers_sql()}),
i AS (SELECT e.id AS entry_id, ident_pos, platform, kind, value, row_number() OVER (ORDER BY e.id, ident_pos) AS ident_id FROM i0 JOIN e ON e.s_suppkey = i0.entry_id)"""

TRACES = ["https://t.me/{h}", "https://tiktok.com/@{h}/video/88{k}", "https://vk.com/club{k}", "https://site-{k}.info/x?y=1&z=2", "https://www.youtube.com/c/{h}"]
#: For each address its identifiers in order.
TRACES_SQL = [[("telegram", "handle", "{h}")], [("tiktok", "handle", "{h}"), ("tiktok", "video", "88{k}")], [("vk", "numeric_id", "{k}")], [("web", "domain", "site-{k}.info")], [("youtube", "handle", "{h}")]]
SHARE = 1000


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of pages, and addresses composed from parts, both visited and saved, that partly meet the list."""
    pages = table(spark, sf_dir, "pages").select(F.lit(0).alias("phase"), F.col("page_id").cast("long").alias("obs_seq"), "url")
    both = _seen(pages).unionByName(trace_parts(table(spark, sf_dir, "part")))
    # dealt out anew: the small files come as a task each, and the parse would be planned for either side of the union
    return both.repartition(spark.sparkContext.defaultParallelism)


def trace_parts(part: DataFrame) -> DataFrame:
    """The addresses of parts, of a table or a stream."""
    k = F.floor(F.col("p_partkey") / len(TRACES)) % SHARE + 1
    h = F.concat(F.lit("supplier_"), F.lpad(k.cast("string"), 9, "0"))
    address = by_case(F.col("p_partkey"), [filled(c, h=h, k=k) for c in TRACES])
    return _seen(part.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("phase"), (F.col("p_partkey") + 1_000_000_000).cast("long").alias("obs_seq"), address.alias("url")))


def _seen(rows: DataFrame) -> DataFrame:
    how = lambda visited, saved: F.when(F.col("phase") == 0, F.lit(visited)).otherwise(F.lit(saved))
    return rows.withColumns({"trace_type": how("visit", "saved"), "source": how("history", "bookmarks"), "occurred_at": F.lit(None).cast("date")})


def _traces_sql() -> str:
    names = {"h": f"'supplier_' || lpad((p_partkey // {len(TRACES)} % {SHARE} + 1)::VARCHAR, 9, '0')", "k": f"p_partkey // {len(TRACES)} % {SHARE} + 1"}
    parts = [
        f"SELECT phase, p_partkey + 1000000000 AS obs_seq, {pos} AS ident_pos, '{p}' AS platform, '{k}' AS kind, {filled_sql(v, **names)} AS value FROM part, (VALUES (0), (1)) f(phase) WHERE p_partkey % {len(TRACES)} = {n}"
        for n, found in enumerate(TRACES_SQL)
        for pos, (p, k, v) in enumerate(found)
    ]
    return " UNION ALL ".join([f"SELECT 0 AS phase, page_id AS obs_seq, 0 AS ident_pos, 'web' AS platform, 'domain' AS kind, {PAGE_HOST_SQL} AS value FROM pages", *parts])


PAGE_HOST_SQL = r"regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^(www\.|m\.)', '')"

_TRACE_NAMES = {"h": f"'supplier_' || lpad((p_partkey // {len(TRACES)} % {SHARE} + 1)::VARCHAR, 9, '0')", "k": f"p_partkey // {len(TRACES)} % {SHARE} + 1"}
TRACE_URLS_SQL = " UNION ALL ".join(["SELECT page_id AS obs_seq, url FROM pages", *[f"SELECT p_partkey + 1000000000, {filled_sql(u, **_TRACE_NAMES)} FROM part WHERE p_partkey % {len(TRACES)} = {n}" for n, u in enumerate(TRACES)]])
TRACES_CTE = f"o AS ({_traces_sql()})"
