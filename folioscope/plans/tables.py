"""Registered queries: typed table views."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import cells as CE
from folioscope.functions import clock
from folioscope.functions import text as X
from folioscope.operators import views as V
from folioscope.operators.paging import global_rank
from folioscope.plans.registry import plan, table

BRANDS = tuple((f"Brand#{i}", f"B {i}") for i in range(1, 24))
TAGS = (("ECONOMY", "Cheap"), ("STANDARD", "Plain"), ("PROMO", "Sale"), ("ring", "Ring"), ("widget", "Widget"))
COLUMNS = [
    V.TableColumn("title", "Title", "text"),
    V.TableColumn("price", "Price", "number", fmt="USD"),
    V.TableColumn("brand", "Brand", "select", BRANDS),
    V.TableColumn("tags", "Tags", "multiSelect", TAGS),
    V.TableColumn("due", "Due", "date"),
    V.TableColumn("done", "Done", "checkbox"),
    V.TableColumn("share", "Share", "progress"),
]


def _raw(spark, sf):
    """part as untyped cells: brands and tags that are no longer options, blank titles, bad dates."""
    part = table(spark, sf, "part")
    text = lambda c: F.col(c).cast("string")
    values = F.create_map(
        F.lit("title"), F.when(F.col("p_size") > 2, F.concat_ws(" ", "p_name", text("p_size"))).otherwise(""),
        F.lit("price"), F.when(F.col("p_size") != 7, text("p_retailprice")),
        F.lit("brand"), F.col("p_brand"),
        F.lit("due"), F.concat(F.lit("2024-02-"), F.when(F.col("p_size") < 10, "0").otherwise(""), text("p_size")),
        F.lit("done"), F.when(F.col("p_type") == "ECONOMY", "true"),
        F.lit("share"), F.when(F.col("p_size") > 4, (F.col("p_size") * 3 - 20).cast("string")),
    )
    lists = F.create_map(F.lit("tags"), F.array_append(F.split("p_name", " "), F.col("p_type")))
    return part.select(F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("position"), values.alias("values"), lists.alias("lists"))


def _rows(spark, sf):
    return V.typed_table(_raw(spark, sf), COLUMNS)


ROWS = """r as (select p_partkey as row_id, case when p_size > 2 then p_name || ' ' || p_size else '' end as title, case when p_size <> 7 then p_retailprice end as price, p_brand as brand0,
 case when regexp_extract(p_brand, '[0-9]+')::int between 1 and 23 then p_brand end as brand, list_distinct(string_split(p_name, ' ') || [p_type]) as tags0, case when p_size < 30 then make_date(2024, 2, p_size) end as due, p_type = 'ECONOMY' as done,
 case when p_size > 4 then least(greatest(p_size * 3 - 20, 0), 100) end as share, p_size from part),
t as (select *, list_filter(tags0, lambda x: list_contains(['ECONOMY', 'STANDARD', 'PROMO', 'ring', 'widget'], x)) as tags from r)"""


@plan(f"""with {ROWS} select row_id, title, price, brand0 as brand, array_to_string(list_sort(tags0), ',') as tags, strftime(due, '%Y-%m-%d') as due, done, share from t""")
def typed_table(spark, sf):
    return _rows(spark, sf).select(
        "row_id", "title", "price", "brand", F.array_join(F.array_sort("tags"), ",").alias("tags"), clock.day_text(F.col("due")).alias("due"), "done", "share"
    )


WHERE = V.Group(
    "and",
    (
        V.Condition("price", "gte", 905),
        V.Condition("missing", "is", "x"),
        V.Condition("title", "contains", ""),
        V.Group("or", (V.Condition("tags", "hasAnyOf", ("ring", "PROMO")), V.Condition("due", "before", "2024-02-11"), V.Condition("done", "isChecked"))),
        V.Group("and", (V.Condition("brand", "isNoneOf", ("Brand#3", "Brand#4")), V.Condition("share", "neq", 100))),
        V.Group("and", ()),
    ),
)


@plan(f"""with {ROWS} select row_id from t where price >= 905 and (list_has_any(tags, ['ring', 'PROMO']) or coalesce(due < '2024-02-11', false) or done) and (brand is null or brand not in ('Brand#3', 'Brand#4')) and coalesce(share <> 100, true)""")
def view_filter(spark, sf):
    return _rows(spark, sf).filter(V.filter_group(WHERE, COLUMNS)).select("row_id")


CONDITIONS = {
    "c01": V.Condition("title", "contains", "RING"), "c02": V.Condition("title", "notContains", "ring"), "c03": V.Condition("title", "startsWith", "re"),
    "c04": V.Condition("title", "endsWith", "9"), "c05": V.Condition("title", "isEmpty"), "c06": V.Condition("price", "eq", 905.5), "c07": V.Condition("price", "neq", 905.5),
    "c08": V.Condition("price", "lt", 903), "c09": V.Condition("price", "isEmpty"), "c10": V.Condition("due", "is", "2024-02-05"), "c11": V.Condition("due", "onOrAfter", "2024-02-20"),
    "c12": V.Condition("due", "after", "2024-02-20"), "c13": V.Condition("brand", "isAnyOf", ("Brand#1", "Brand#2")), "c14": V.Condition("brand", "isNoneOf", ("Brand#1",)),
    "c15": V.Condition("brand", "isEmpty"), "c16": V.Condition("tags", "hasAllOf", ("ring", "PROMO")), "c17": V.Condition("tags", "hasNoneOf", ("ring", "PROMO")),
    "c18": V.Condition("tags", "isEmpty"), "c19": V.Condition("done", "isUnchecked"), "c20": V.Condition("share", "gt", 90), "c21": V.Condition("share", "lte", 0),
    "c22": V.Condition("title", "is", "small ring 11"), "c23": V.Condition("title", "isNot", "small ring 11"), "c24": V.Condition("due", "isNotEmpty"),
}


@plan(f"""with {ROWS} select row_id, contains(lower(title), 'ring') as c01, not contains(lower(title), 'ring') as c02, starts_with(lower(title), 're') as c03, ends_with(title, '9') as c04, title = '' as c05, coalesce(price = 905.5, false) as c06, coalesce(price <> 905.5, true) as c07,
coalesce(price < 903, false) as c08, price is null as c09, coalesce(due = '2024-02-05', false) as c10, coalesce(due >= '2024-02-20', false) as c11, coalesce(due > '2024-02-20', false) as c12, coalesce(brand in ('Brand#1', 'Brand#2'), false) as c13, coalesce(brand <> 'Brand#1', true) as c14,
brand is null as c15, list_has_all(tags, ['ring', 'PROMO']) as c16, not list_has_any(tags, ['ring', 'PROMO']) as c17, len(tags) = 0 as c18, not done as c19, coalesce(share > 90, false) as c20, coalesce(share <= 0, false) as c21, lower(title) = 'small ring 11' as c22, lower(title) <> 'small ring 11' as c23, due is not null as c24 from t""")
def view_conditions(spark, sf):
    by_id = {c.id: c for c in COLUMNS}
    return _rows(spark, sf).select("row_id", *[V.match_condition(c, by_id[c.column]).alias(name) for name, c in CONDITIONS.items()])


@plan(f"""with {ROWS}, o as (select *, list_sort(list_transform(tags, lambda x: list_position(['ECONOMY', 'STANDARD', 'PROMO', 'ring', 'widget'], x))) as tp, regexp_extract(brand, '[0-9]+')::int as bp from t)
select row_id, row_number() over (order by case when len(tags) = 0 then 1 else 0 end, tp desc, case when brand is null then 1 else 0 end, bp, case when price is null then 1 else 0 end, price desc, row_id) as place from o""")
def view_sort(spark, sf):
    """Places of all rows under three sorts, so that the order itself is compared."""
    order = V.sort_keys(COLUMNS, (("tags", "desc"), ("brand", "asc"), ("price", "desc")))
    return global_rank(_rows(spark, sf), order).select("row_id", "place")


@plan(r"""with n as (select p_partkey as row_id, p_name || ' ' || p_size as title, p_name as word, p_size from part) select row_id, row_number() over (order by word, p_size, row_id) as place from n""")
def natural_order(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.concat_ws(" ", "p_name", "p_size").alias("title"))
    return global_rank(rows, [CE.natural_key(F.col("title")), F.col("row_id")]).select("row_id", "place")


@plan(f"""with {ROWS} select row_id, title, done from t where price >= 905 and (list_has_any(tags, ['ring', 'PROMO']) or coalesce(due < '2024-02-11', false) or done) and (brand is null or brand not in ('Brand#3', 'Brand#4')) and coalesce(share <> 100, true)
and (contains(lower(title), 'b 1') or contains('$' || printf('%,.2f', price), 'b 1') or contains('b ' || regexp_extract(brand, '[0-9]+'), 'b 1'))""")
def table_view(spark, sf):
    return V.table_view(_rows(spark, sf), COLUMNS, V.View("B 1", WHERE, (("title", "asc"),), ("done",)))


GROUPED = """spine as (select unnest(['Brand#5', 'Brand#2'] || list_filter([('Brand#' || i) for i in range(1, 24)], lambda b: b not in ('Brand#5', 'Brand#2')) || ['__empty__']) as group_key, generate_subscripts(['Brand#5', 'Brand#2'] || list_filter([('Brand#' || i) for i in range(1, 24)], lambda b: b not in ('Brand#5', 'Brand#2')) || ['__empty__'], 1) - 1 as group_position)"""


@plan(f"""with {ROWS}, {GROUPED}, c as (select coalesce(brand, '__empty__') as group_key, row_id, row_number() over (partition by coalesce(brand, '__empty__') order by row_id) as card from t)
select group_key, group_position, row_id, card from spine left join c using (group_key)""")
def view_group(spark, sf):
    return V.group_rows(_rows(spark, sf), COLUMNS, "brand", V.View(group_order=("Brand#5", "gone", "Brand#2")))


@plan(f"""with {ROWS}, e as (select row_id, price, unnest(case when len(tags) > 0 then tags else ['__empty__'] end) as group_key from t), spine as (select unnest(['ECONOMY', 'STANDARD', 'PROMO', 'ring', 'widget', '__empty__']) as group_key)
select group_key, count(row_id) as cards, min_by(row_id, (case when price is null then 1 else 0 end, -price, row_id)) as first_row from spine left join e using (group_key) group by 1""")
def view_group_tags(spark, sf):
    cards = V.group_rows(_rows(spark, sf), COLUMNS, "tags", V.View(sorts=(("price", "desc"),)))
    return cards.groupBy("group_key").agg(F.count("row_id").alias("cards"), F.min_by("row_id", "card").alias("first_row"))


@plan(f"""with {ROWS}, e as (select case when done then '__checked__' else '__unchecked__' end as group_key, row_id from t) select group_key, count(*) as cards from e group by 1""")
def view_group_checkbox(spark, sf):
    return V.group_rows(_rows(spark, sf), COLUMNS, "done", V.View()).groupBy("group_key").agg(F.count("row_id").alias("cards"))


@plan(f"""with {ROWS}, s as (select row_id, due as start, greatest(due, coalesce(due + case when done then 3 end, due)) as stop from t where due is not null), d as (select row_id, start, stop, unnest(generate_series(start, stop, interval 1 day))::date as day from s)
select row_id, strftime(start, '%Y-%m-%d') as start, strftime(stop, '%Y-%m-%d') as stop, strftime(day, '%Y-%m-%d') as day from d""")
def calendar_rows(spark, sf):
    rows = _rows(spark, sf).withColumn("until", F.when(F.col("done"), F.date_add("due", 3)).otherwise(F.when(F.col("share") > 50, F.date_add("due", -4))))
    out = V.calendar_rows(rows, "due", "until")
    return out.select("row_id", *[clock.day_text(F.col(c)).alias(c) for c in ("start", "stop", "day")])


@plan(f"""with {ROWS} select row_id, array_to_string(list_sort(list_filter(tags0, lambda x: x <> 'ring') || case when list_contains(tags0, 'PROMO') then [] else ['PROMO'] end), ',') as tags, 'Brand#9' as brand, strftime(due + 7, '%Y-%m-%d') as due from t""")
def move_and_shift(spark, sf):
    rows = _rows(spark, sf)
    by_id = {c.id: c for c in COLUMNS}
    moved = rows.withColumns(
        {"tags": V.move_group(by_id["tags"], F.col("tags"), "ring", "PROMO"), "brand": V.move_group(by_id["brand"], F.col("brand"), "", "Brand#9")}
    )
    out = V.shift_dates(moved, "due", None, 7)
    return out.select("row_id", F.array_join(F.array_sort("tags"), ",").alias("tags"), "brand", clock.day_text(F.col("due")).alias("due"))


@plan(f"""with {ROWS} select row_id, case when title <> '' then lower(title) end as as_select, case when p_size <> 7 then trunc(price) end as as_number, contains(lower(title), 'zzz') as as_checkbox, case when p_size between 1 and 12 then '2024-' || lpad(p_size::varchar, 2, '0') || '-03' end as as_date from t""")
def convert_column(spark, sf):
    rows = _rows(spark, sf).withColumn("p_size", F.regexp_extract(clock.day_text(F.col("due")), r"-(\d+)$", 1))
    size = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), "p_size")
    rows = rows.drop("p_size").join(size, "row_id")
    rows = rows.withColumns(
        {
            "priced": F.when(F.col("p_size") != 7, F.concat(F.lit("$ "), F.format_number(F.floor("price"), 0), F.lit(" each"))).otherwise("n/a"),
            "dated": F.concat(F.lit("2024/"), F.col("p_size").cast("string"), F.lit(".3")),
        }
    )
    text = lambda name: V.TableColumn(name, name, "text")
    out = V.convert_column(rows.withColumn("flag", F.col("title")), text("title"), "select")
    out = V.convert_column(out, text("priced"), "number")
    out = V.convert_column(out, text("flag"), "checkbox")
    out = V.convert_column(out, text("dated"), "date")
    return out.select("row_id", F.col("title").alias("as_select"), F.col("priced").alias("as_number"), F.col("flag").alias("as_checkbox"), clock.day_text(F.col("dated")).alias("as_date"))


@plan("""with n as (select p_partkey as position, unnest([upper(p_name), p_type]) as name, unnest([0, 1]) as n from part) select lower(name) as key, min_by(name, (position, n)) as name, min((position, n))[1] as position from n group by 1""")
def column_options(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("position"), F.concat(F.upper("p_name"), F.lit(" ， "), "p_type", F.lit(",")).alias("title")
    )
    return V.column_options(rows, V.TableColumn("title")).select("key", "name", "position")


@plan(r"""select p_partkey, printf('%,.2f', p_retailprice) as grouped, '$' || printf('%,.2f', p_retailprice) as usd, printf('%d', p_size) || '%' as percent, p_retailprice as parsed, 'https://' || replace(p_name, ' ', '-') || '.example.org/a' as href from part""")
def number_formats(spark, sf):
    price = F.col("p_retailprice")
    usd = CE.format_number(price, "USD")
    return table(spark, sf, "part").select(
        "p_partkey", CE.format_number(price, "grouped", 2).alias("grouped"), usd.alias("usd"), CE.format_number(F.col("p_size").cast("double"), "percent").alias("percent"),
        CE.parse_number(F.concat(F.lit("¥ "), F.format_number(price, 2))).alias("parsed"),
        CE.url_href(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".example.org/a"))).alias("href"),
    )


# --- functions over whole texts ----------------------------------------------------------------------------

FOLD = "replace(lower(strip_accents({0})), 'ß', 'ss')"


@plan(rf"""select doc_id, sha256({FOLD.format('text')}) as folded, sha256(trim(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'))) as title, sha256(text) as digest,
 len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./:\-]{{2,}}')), lambda t: t not in ('and','are','for','how','the','what','when','where','which','who','why')))::bigint as terms,
 sha256(trim(regexp_replace(text, '[\x00-\x1f\x7f\s]+', ' ', 'g'))[1:500]) as detail from documents""")
def text_functions(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", X.sha256_hex(X.fold(text)).alias("folded"), X.sha256_hex(F.trim(X.normalize_title(text))).alias("title"), X.sha256_hex(text).alias("digest"),
        F.size(X.informative_terms(X.normalize_search(text))).cast("long").alias("terms"), X.sha256_hex(X.error_detail(text)).alias("detail"),
    )


@plan("select doc_id from documents where contains(replace(lower(strip_accents(text)), 'ß', 'ss'), 'uber_') or contains(replace(lower(strip_accents(text)), 'ß', 'ss'), 'de la') or contains(lower(source), 'c1%')")
def contains_folded(spark, sf):
    hit = X.contains_folded(F.col("text"), "über_") | X.contains_folded(F.col("text"), "De LÀ") | X.contains_folded(F.col("source"), "c1%")
    return table(spark, sf, "documents").filter(hit).select("doc_id")


@plan("""with w as (select o_orderkey, o_orderdate + (o_orderkey % 1440) * interval 1 minute as ts, o_orderpriority as p from orders), l as (select *, extract(hour from ts + interval 8 hour) * 60 + extract(minute from ts + interval 8 hour) as m from w),
o as (select *, case p when '1-URGENT' then true when '2-HIGH' then m >= 1320 or m < 360 when '5-LOW' then true else m >= 60 and m < 300 end as open from l)
select o_orderkey, open, strftime(case when not open then ts + (case when p = '2-HIGH' then 1320 - m else case when 60 - m <= 0 then 60 - m + 1440 else 60 - m end end)::int * interval 1 minute end, '%Y-%m-%d %H:%M') as next_open from o""")
def compile_windows(spark, sf):
    p = F.col("o_orderpriority")
    rows = table(spark, sf, "orders").withColumn("ts", F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int")))
    enabled = p != "1-URGENT"
    start = F.when(p == "2-HIGH", "22:00").when(p == "5-LOW", "9:99").otherwise("01:00")
    stop = F.when(p == "2-HIGH", "06:00").otherwise("05:00")
    return rows.select(
        "o_orderkey", clock.window_open(enabled, start, stop, F.col("ts")).alias("open"),
        F.date_format(clock.next_open(enabled, start, stop, F.col("ts")), "yyyy-MM-dd HH:mm").alias("next_open"),
    )


@plan("select strftime(date_trunc('week', ts + interval 8 hour), '%Y-%m-%d') as week, count(*) as n from events group by 1")
def weekly_counts(spark, sf):
    weeks = table(spark, sf, "events").groupBy(clock.day_text(clock.week_start(F.col("ts"))).alias("week"))
    return weeks.agg(F.count("*").alias("n"))


@plan("select event_id from events where ts >= '2024-01-05' and ts < '2024-01-21'")
def modified_between(spark, sf):
    return table(spark, sf, "events").filter(clock.modified_between(F.col("ts"), "2024-01-05", "2024-01-20")).select("event_id")
