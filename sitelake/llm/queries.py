"""Registered queries of the text operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelake.session import apply_settings, ship_package

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder; it runs with the package's settings and with the package on the workers."""

    def register(build: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            ship_package(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql.strip()
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_compression_bands")
def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


@query("op10_toxicity_bags")
def op10_toxicity_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.toxicity import score_toxicity, train_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


@query("op4_source_schedule")
def op4_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


@query(
    "op7_legacy_archives",
    sql="""
    with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
    d as (
        select *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (((('0x' || substr(hex, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - i % 4 * 5)::int) & 31) + 1)::int, 1)), '') as payload_digest,
            min(page_id) over (partition by hex, payload_bytes) as first_page
        from p
    )
    select page_id, payload_bytes, payload_digest, case when page_id = first_page then 'response' else 'revisit' end as record_type,
        case when page_id <> first_page then first_page end as refers_to
    from d
    """,
)
def op7_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.warc import archive_round_trip

    read = archive_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_transducer_bpe")
def op5_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.bpe import build_lexicon, encode

    docs = table(spark, sf_dir, "documents")
    return encode(docs, tokenizer_path(), build_lexicon(docs, tokenizer_path()), digests=True)


@query("op8_imatch")
def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.imatch import band_lexicon, edited_fingerprints

    docs = table(spark, sf_dir, "documents")
    return edited_fingerprints(docs, band_lexicon(docs)).drop("next_id")


@query(
    "op1_jaccard_regions",
    sql=r"""
    with recursive w as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
    ),
    sh as (
        select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')]
            else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as s
        from w
    ),
    sizes as (select doc_id, count(*) as n from sh group by 1),
    pairs as (
        select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
    ),
    links as (
        select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)
    ),
    both_ways as (select x, y from links union all select y, x from links),
    reach as (
        select doc_id as x, doc_id as y from w
        union
        select r.x, b.y from reach r join both_ways b on r.y = b.x
    )
    select w.doc_id, coalesce(n, 0)::bigint as n_shingles, c.component_id
    from w left join sizes using (doc_id) join (select x as doc_id, min(y) as component_id from reach group by 1) c using (doc_id)
    """,
)
def op1_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


@query("op6_previous_factors")
def op6_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep_first=False, texts=False, report=200)


@query("op3_katz_backoff")
def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"))


@query("op2_wrapper_text")
def op2_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.wrappers import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op11_anchor_expansion")
def op11_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.anchors import personal_data, span_digests

    return span_digests(personal_data(table(spark, sf_dir, "documents")))


@query(
    "op12_recursive_interactions",
    sql=r"""
    with recursive t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as s from documents),
    w as (
        select *, regexp_extract_all(s, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by s) as first_id from t
    ),
    d as (
        select doc_id, part, (case when len(ws) < 200 then 1 else 0 end) + (case when 100 * list_unique(ws) < 50 * len(ws) then 2 else 0 end)
            + (case when 100 * (length(s) - length(regexp_replace(s, '[A-Z]', '', 'g'))) > 2 * length(s) then 4 else 0 end)
            + (case when regexp_matches(s, '[#$%&*|]') then 8 else 0 end) + (case when doc_id > first_id then 16 else 0 end) as mask
        from w
    ),
    m as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
    c as (
        select part, mask, count(*) as n, sum(coalesce(good, 0)) as n_good, sum(coalesce(toxic, 0)) as n_toxic from d left join m using (doc_id) group by 1, 2
    ),
    e as (
        select '' as prefix, 0 as step, 0 as bit, 0 as seen
        union all
        select prefix || substr('ABCDE', i, 1), step + 1, 1 << (i - 1), seen | bit
        from e, (select unnest(range(1, 6))::int as i) where step < 5 and not contains(prefix, substr('ABCDE', i, 1))
    ),
    p as (
        select part, prefix, bit, sum(case when mask & (seen | bit) = 0 then n else 0 end) as kept,
            sum(case when mask & bit > 0 and mask & seen = 0 then n else 0 end) as removed,
            sum(case when mask & bit > 0 and mask & seen > 0 then n else 0 end) as redundant,
            sum(case when mask = bit then n else 0 end) as unique_fails,
            sum(case when mask & bit > 0 and mask & seen = 0 then n_good else 0 end) as good_lost,
            sum(case when mask & bit > 0 and mask & seen = 0 then n_toxic else 0 end) as toxic_lost
        from c, e where step > 0 group by 1, 2, 3
    ),
    o as (select prefix as filter_order, unnest(range(1, 6))::int as step from e where step = 5),
    r as (select filter_order, o.step, p.* exclude (prefix) from o join p on p.prefix = substr(filter_order, 1, o.step))
    select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
        unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
        (sum(removed) over (partition by part, bit))::bigint as shapley
    from r
    """,
)
def op12_recursive_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.interactions import document_cells, interaction_audit

    return interaction_audit(document_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@query(
    "op13_tiled_collocations",
    sql=r"""
    with t as (
        select coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]') as pieces from documents
    ),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (select lang, unnest(pieces) as piece from t)),
    total as (select lang, sum(len(ws))::bigint as n from w group by 1),
    f as (
        select lang, k, p, count(*) as f from (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) as p from w, range(1, 4) r(k))
        group by 1, 2, 3 having count(*) >= 10
    ),
    cuts as (
        select c.lang, c.p, c.f as a, l.f as l, r.f as r, l.k as cut, (1000000::hugeint * c.f * c.f) // (l.f::hugeint * r.f::hugeint) as score
        from f c join f l on l.lang = c.lang and l.k < c.k and l.p = c.p[:l.k] join f r on r.lang = c.lang and r.p = c.p[l.k + 1:]
    ),
    best as (select * from cuts qualify row_number() over (partition by lang, p order by score, cut) = 1),
    longer as (
        select lang, p, max(f) as longer from (select lang, p[1:2] as p, f from f where k = 3 union all select lang, p[2:3], f from f where k = 3) group by 1, 2
    ),
    ranked as (
        select b.lang, array_to_string(b.p, ' ') as phrase, a, l, r, score from best b left join longer using (lang, p) where coalesce(100 * longer < 50 * a, true)
    )
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
    from ranked join total using (lang) qualify rank <= 2000
    """,
)
def op13_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))
