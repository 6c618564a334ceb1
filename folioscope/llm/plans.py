"""The queries of this subpackage over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontam, licenses, lines, lm, main_text, mixing, pii, quality, secrets, simhash, spelling, tokens, whitening
from folioscope.llm.common import sha_of_list, table
from folioscope.llm.spans import count_of, listed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            CHECKS[fn.__name__] = sql
        return fn

    return keep


DOC_ID = "row.doc_id"


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents and the verdict by divergence from their language."""
    judged = quality.assess(table(spark, sf_dir, "documents"))
    return judged.select(DOC_ID, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(f"""
with pieces as (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from documents),
lines as (select doc_id, unnest(p) as line, generate_subscripts(p, 1) as place from pieces),
keyed as (select *, translate(trim(line, {SQL_SPACE}), '{UPPER}', '{LOWER}') as key from lines),
common as (select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select k.*, c.keeper is not null and c.keeper <> k.doc_id as gone from keyed k left join common c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters found in 5 documents are dropped outside the largest document id."""
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(DOC_ID, "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(f"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
i as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
iw as (select distinct item_id, list_slice(w, k, k + 9) as win from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as k from i where len(w) > 0)),
sizes as (select distinct len(win) as n from iw),
dw as (select doc_id, k, n, list_slice(w, k, k + n - 1) as win from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)),
hits as (select distinct doc_id, k, n from dw where win in (select win from iw)),
words_hit as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(k, k + n)) as p from hits) group by 1),
items as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as l from (select distinct dw.doc_id, cast(iw.item_id as varchar) as item from dw join iw on dw.win = iw.win) group by 1)
select d.doc_id, len(d.w) as n_words, coalesce(h.n, 0) as n_hit, coalesce(t.n, 0) as n_items, sha256(coalesce(t.l, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from d left join words_hit h on h.doc_id = d.doc_id left join items t on t.doc_id = d.doc_id
""")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside verbatim matches with benchmark items."""
    found = decontam.find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        DOC_ID, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha_of_list(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those within two bits."""
    found = simhash.cluster(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to targets by source."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(DOC_ID, "size", "source_size", "target", "taken")


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, from a cache that begins empty."""
    docs = table(spark, sf_dir, "documents")
    counted = tokens.count_tokens(docs.select("doc_id", "text"), tokens.new_cache(spark), blanks_split=True)
    return counted.select(DOC_ID, "n_bytes", "n_tokens", "over_limit")


@query()
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, from a ledger that begins empty."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), secrets.new_ledger(spark))
    base = F.filter("spans", lambda s: s["kind"].isin(secrets.BASE))
    return found.select(
        DOC_ID, *[count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


@query()
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, by fixed patterns and by contexts learned from them."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), *[count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


@query()
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences and their known sentences in all documents."""
    found = licenses.scan_licences(table(spark, sf_dir, "documents"))
    return found.select(
        DOC_ID, F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"),
    )


@query()
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of those not held out."""
    scored = lm.score_documents(table(spark, sf_dir, "documents"))
    return scored.select(F.col("doc").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their sixteen leading components, whitened."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.select("row.vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")


@query("""
with a as (select page_id, url, regexp_extract(html, '<article>([\\s\\S]*)</article>', 1) as body from pages),
b as (select page_id, url, list_transform(string_split(regexp_replace(replace(replace(body, '<br>', ' '), '<b>', ''), '</?(p|h1)>', chr(1), 'g'), chr(1)),
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))) as parts from a)
select page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) as text,
  length(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10))) as n_chars from b
""")
def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages. The SQL knows the one layout of the given tables; tests have others."""
    found = main_text.extract_main(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", "n_chars")


@query(f"""
with recursive steps as (select i, i as v, 0 as k from range(256) t(i) union all
  select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from steps where k < 8),
crc as (select list(v order by i) as t from steps where k = 8),
runs as (select doc_id, run, count(*) as c from (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') as run from documents) group by all),
bytes as (select *, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as h from runs),
hashed as (select run, c, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: (position(h[2 * i + 1] in '0123456789ABCDEF') - 1) * 16 + position(h[2 * i + 2] in '0123456789ABCDEF') - 1),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) as h from bytes, crc),
typed as (select case when h % 97 = 0 then run[1:h % len(run)] || run[h % len(run) + 2:] else run end as word, c from hashed),
words as (select word, cast(sum(c) as bigint) as n from typed where length(word) >= 5 group by word having sum(c) >= 3),
cut as (select word, n, i, word[1:i - 1] || word[i + 1:] as short from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (
  select a.word, b.word as near, b.n as m from cut a join cut b on a.short = b.short and a.i = b.i and a.word <> b.word
  union select c.word, w.word, w.n from cut c join words w on w.word = c.short
  union select w.word, c.word, c.n from cut c join words w on w.word = c.short),
best as (select word, count(*) as n_near, arg_min(near, row(-m, near)) as form, max(m) as form_n from pairs group by word),
known as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * w.n then form end as form, case when form_n >= 2 * w.n then form_n end as form_n from words w left join best b on b.word = w.word),
chain as (select word, word as tip, 0 as k from known union all select c.word, k.form, c.k + 1 from chain c join known k on k.word = c.tip where k.form is not null)
select k.word, k.n, k.n_near, k.form, k.form_n, r.root from known k join (select word, arg_max(tip, k) as root from chain group by word) r on r.word = k.word
""")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some mistyped, with the word each is a variant of."""
    return spelling.group_variants(spelling.word_counts(table(spark, sf_dir, "documents"), drop_every=97))
