"""The registered queries of this subpackage, each over the whole of its table."""

from functools import wraps

from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from criteria_engine.llm import (
    bagminhash, decontaminate, html_extract, language, license_scan, line_dedup, merkle, packing, substring, token_files, token_links, topk, toxicity,
)
from criteria_engine.llm.tables import prepare, scratch, table

TOP = 5
QUERY_STEP = 50


def op1_line_dedup(spark, sf_dir):
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return rows.select("doc_id", "n_lines", "n_removed", digest)


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op3_html(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bagminhash(spark, sf_dir):
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


def op7_exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % QUERY_STEP == 0, TOP)


def op8_token_files(spark, sf_dir):
    folder = scratch(spark)
    shards = token_files.write_ids(table(spark, sf_dir, "documents"), folder)
    rows = token_files.read_ids(spark, folder, shards)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op10_substring(spark, sf_dir):
    rows = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    changed = {"text": merkle.tampered(F.col("text"), F.col("doc_id"))}
    found = merkle.manifest(docs, tampered=merkle.leaf([changed.get(c, F.col(c)) for c in merkle.COLUMNS]))
    siblings = F.concat_ws("", F.transform("proof", lambda step: step["siblings"]))
    return merkle.folded(found, "tampered").select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_token_links(spark, sf_dir):
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_links.link_tokens(table(spark, sf_dir, "documents"), *paths)


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        return query(prepare(spark), sf_dir)

    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        op1_line_dedup, op2_toxicity, op3_html, op4_decontamination, op5_bagminhash, op6_packing, op7_exact_topk, op8_token_files, op9_language, op10_substring,
        op11_license_scan, op12_merkle_manifest, op13_token_links,
    )
} | {"pipeline": _shipped(corpus_pipeline.run)}

ORACLES = {
    "op11_license_scan": license_scan.oracle(),
    "op7_exact_topk": f"""
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
        ), s as (
            select q.vec_id as query_id, c.vec_id,
                   cast(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id
            where q.vec_id % {QUERY_STEP} = 0
        ), r as (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s
        )
        select query_id, cast(place as integer) as rank, vec_id, score from r where place <= {TOP}
    """,
}
