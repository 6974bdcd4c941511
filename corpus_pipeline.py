"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

Language ID drops documents without a nameable language; MinHash near-dedup keeps one document of each
group; decontamination drops documents that hold a benchmark item; the secret scan masks live
credentials; packing cuts what is left into pieces of power-of-two length. Each stage works on all
rows and columns its predecessor kept.
"""
from ledgerlens.llm import decontamination, language, near_dedup, packing, secrets
from ledgerlens.llm.tables import stage


def language_id(spark, docs, sf_dir):
    """Learns from the documents' own labels, in the folds that op3 learns from."""
    return language.spoken(docs, language.fit(docs.where(~language.held_out(docs["doc_id"], 4, 2))))


def minhash_near_dedup(spark, docs, sf_dir):
    return near_dedup.deduplicated(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark, docs, sf_dir):
    return secrets.redacted(docs)


def pack_documents(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [(fn.__name__, fn) for fn in (language_id, minhash_near_dedup, benchmark_decontamination, secret_scan, pack_documents)]

#: Language model, tokenizer and template matching have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
