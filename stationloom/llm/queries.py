"""The registered queries of this package, ``opN_<name>``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stationloom.llm import centroids, exact_dedup, language, minhash, mixing, pieces, quality, scoring, sharding, simhash
from stationloom.llm import token_files, toxicity, whitening
from stationloom.llm.common import documents


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(pieces.encode_documents(
        documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model")))


def op2_quality_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(documents(spark, folder))


def op3_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(documents(spark, folder))


def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, folder))


def op5_language_models(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(documents(spark, folder))


def op6_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, folder), [1.0] * 8)


def op7_toxic_passages(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")
    return toxicity.rate(documents(spark, folder), labels)


def op8_attention_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_texts(documents(spark, folder), scoring.Settings(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, folder))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


def op11_minhash_prints(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.edit_likeness(documents(spark, folder))


def op12_whitened_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet"))


def op13_filtered_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_divergence": op2_quality_divergence,
    "op3_simhash_groups": op3_simhash_groups,
    "op4_mix_sources": op4_mix_sources,
    "op5_language_models": op5_language_models,
    "op6_rendezvous_shards": op6_rendezvous_shards,
    "op7_toxic_passages": op7_toxic_passages,
    "op8_attention_scores": op8_attention_scores,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_files": op10_token_files,
}

# edited texts and vectors; listed apart from the ten operators above, registered with them
FURTHER: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op11_minhash_prints": op11_minhash_prints,
    "op12_whitened_vectors": op12_whitened_vectors,
    "op13_filtered_centroids": op13_filtered_centroids,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _divergence(p: str, q: str) -> str:
    """A bin's share of the Jensen-Shannon divergence, base 2."""
    return (f"(case when {p} > 0 then {p} * log2({p} / (({p} + {q}) / 2)) else 0 end"
            f" + case when {q} > 0 then {q} * log2({q} / (({p} + {q}) / 2)) else 0 end) / 2")


def quality_sql(limits: quality.Limits = quality.Limits()) -> str:
    """The counts, references and verdicts of ``quality.judge``; document ids must be unique."""
    classes = ["n_symbols", "n_digit", "n_upper", "n_point", "n_foreign", "n_gap", "n_plain"]
    digit, upper, point, foreign = (quality.CLASSES[c].replace("'", "''") for c in ("_digit", "_upper", "_point", "_foreign"))
    per_class = " + ".join(_divergence(f"f.{c} / greatest(f.total, 1)", f"r.{c} / r.total") for c in classes)
    return rf"""
        with t as (select doc_id, lang, coalesce(text, '') as x from documents),
        w as (select *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as words,
            list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from t),
        g as (select doc_id, i, count(*) over (partition by doc_id, list_slice(words, i, i + 4)) as c
            from w, unnest(range(1, len(words) - 3)) r(i)),
        s as (select doc_id, least(5, coalesce(lead(i) over (partition by doc_id order by i) - i, 5)) as n from g where c > 1),
        h as (select doc_id, sum(n) as n_repeat_words from s group by 1),
        b as (select doc_id, lang, words, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
            len(regexp_extract_all(x, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
            cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, length(x) as total,
            len(regexp_extract_all(x, '{digit}')) as n_digit, len(regexp_extract_all(x, '{upper}')) as n_upper,
            len(regexp_extract_all(x, '{point}')) as n_point, len(regexp_extract_all(x, '{foreign}')) as n_foreign
            from w left join h using (doc_id)),
        f as (select *, total - word_chars as n_gap, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
            greatest(word_chars - n_symbols - n_digit - n_upper - n_point - n_foreign, 0) as n_plain from b),
        r as (select lang, sum(n_words) as n, {", ".join(f"sum({c}) as {c}" for c in classes)},
            {" + ".join(f"sum({c})" for c in classes)} as total from f where lang is not null group by 1
            having sum(n_words) > 0),
        u as (select doc_id, lang, unnest(words) as word from f),
        k as (select lang, word, count(*) as n from u where lang is not null and length(word) <= {limits.common_chars} group by 1, 2
            qualify row_number() over (partition by lang order by n desc, word) <= {limits.common}),
        v as (select distinct word from k),
        d as (select doc_id, word, count(*) as n from u where word in (select word from v) group by 1, 2),
        q as (select r.lang, v.word, coalesce(k.n, 0) / r.n as q from r cross join v left join k on k.lang = r.lang and k.word = v.word),
        e as (select f.doc_id, q.lang, sum({_divergence("coalesce(d.n, 0) / greatest(f.n_words, 1)", "q.q")}) as dist,
            greatest(1 - sum(coalesce(d.n, 0) / greatest(f.n_words, 1)), 0) as p_other, greatest(1 - sum(q.q), 0) as q_other
            from f cross join q left join d on d.doc_id = f.doc_id and d.word = q.word group by 1, 2),
        m as (select f.doc_id, f.n_words, r.lang, sqrt(greatest({per_class}, 0)) as c,
            sqrt(greatest(e.dist + {_divergence("e.p_other", "e.q_other")}, 0)) as w
            from f cross join r join e on e.doc_id = f.doc_id and e.lang = r.lang),
        z as (select doc_id, arg_min(c, c + w) as c, arg_min(w, c + w) as w,
            bool_or((n_words < {limits.char_words} or c <= {limits.char_distance})
                and (n_words < {limits.word_words} or w <= {limits.word_distance})) as fits from m group by 1)
        select f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
            case when f.n_words >= {limits.char_words} then round(z.c, 4) end as char_distance,
            case when f.n_words >= {limits.word_words} then round(z.w, 4) end as word_distance,
            not f.base_failed and (f.n_words < {limits.char_words} or coalesce(z.fits, true)) as kept
        from f left join z using (doc_id)"""


def shards_sql(shards: int = 8) -> str:
    """``sharding.assign_shards`` with even weights; the checksum is worked out byte by byte from its polynomial."""
    score = "-ln((('0x' || substr(md5(doc_id || ':' || s), 1, 13))::bigint + 0.5) / 4503599627370496.0)"
    return f"""
        with p as (select list(list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, i: xor(a >> 1, 3988292384 * (a & 1))) order by n) as byte
            from range(256) t(n)),
        h as (select doc_id, coalesce(text, '') as x, hex(encode(coalesce(text, ''))) as h from documents),
        t as (select doc_id, octet_length(encode(x)) + 1 as size, xor(4294967295, list_reduce(list_prepend(4294967295,
            list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
            lambda a, b: xor(a >> 8, p.byte[xor(a & 255, b) + 1]))) as text_crc32 from h, p),
        s as (select *, (select arg_min(s, {score}) from range({shards}) r(s)) as shard,
            (select arg_min(s, {score}) from range({shards + 1}) r(s)) as grown_shard,
            md5(doc_id || ':' || size || ':' || text_crc32) as m from t)
        select doc_id, size, text_crc32, 'key' as law, cast(shard as integer) as shard,
            row_number() over (partition by shard order by m) - 1 as slot, cast(grown_shard as integer) as grown_shard from s"""


def centroids_sql(rounds: int = centroids.ROUNDS) -> str:
    """``centroids.cluster`` with its fixed settings: every vector against every centroid, in integers."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = ""
    for r in range(rounds + 1):
        steps += f"""
        a{r} as (select vec_id, any_value(v) as v, min(d * {centroids.CLUSTERS} + k) as best from (
            select t.vec_id, t.v, c.k, list_sum(list_transform(range(1, 65), lambda i: (t.v[i] - c.v[i]) * (t.v[i] - c.v[i])))::bigint as d
            from kept t, c{r} c) group by vec_id),"""
        if r < rounds:
            steps += f"""
        c{r + 1} as (select c.k, coalesce(m.v, c.v) as v from c{r} c left join (
            select k, list(({floor})::bigint order by i) as v from (
                select best % {centroids.CLUSTERS} as k, i, sum(v[i])::bigint as s, count(*) as n
                from a{r}, unnest(range(1, 65)) g(i) group by all) group by k) m using (k)),"""
    return f"""
        with kept as (select vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::double)::bigint) as v
            from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
        c0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 as k, v from kept
            qualify k < {centroids.CLUSTERS}),{steps}
        f as (select vec_id, best % {centroids.CLUSTERS} as k, best // {centroids.CLUSTERS} as distance from a{rounds})
        select vec_id, k::integer as cluster, distance, (sum(distance) over (partition by k))::bigint as cluster_inertia,
            (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
        from f join c{rounds} c using (k)"""


ORACLE_SQL: dict[str, str] = {
    "op2_quality_divergence": quality_sql(),
    "op6_rendezvous_shards": shards_sql(),
    "op9_exact_dedup": f"""
        with t as (select doc_id, {LOWER} as norm from documents)
        select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from t""",
}

FURTHER_SQL: dict[str, str] = {"op13_filtered_centroids": centroids_sql()}
