import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
from riskweave.llm import quality, secrets, toxicity
from riskweave.llm.training import labelled_sample

SF = "/root/testdata/sf0.001"


def write_tables(spark, path):
    """The small tables with planted near copies, exact copies, secrets in other texts and an added token of the tokenizers file."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = [r for r in docs.orderBy("doc_id").collect() if r.text and len(r.text.split()) > 60][:12]
    planted = []
    for n, r in enumerate(good):
        text = [f"{r.text} tail", r.text, f"{' '.join(r.text.split()[::-1])} token: 9fe87309f41074dfa91c", f"{r.text} <|endoftext|> tail"][n % 4]
        planted.append(tuple({**r.asDict(), "doc_id": 100_000 + n, "text": text, "n_chars": len(text)}[c] for c in docs.columns))
    docs.union(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")


def without_rejected(rows, sample_of, module, score, rejected, threshold):
    model = module.fit(sample_of(rows))
    return [r for r in rows if int(score(model, r) >= threshold) != rejected]


def toxic_score(model, r):
    n, _, best = model.segments(r.text, model.scorer())
    return model.score(n, best)


def quality_score(machine, r):
    return machine.score(*machine.inputs(*quality.Features(machine.buckets)(r.text, r.n_chars)))


def one_of_each_group(rows, size=5, percent=80):
    """Every two documents compared on sets of word tuples; the smallest id of each component stays."""
    sets, component = [], list(range(len(rows)))
    for r in rows:
        words = (r.text or "").encode().lower().split()
        n = min(size, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and component[i] != component[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = component[i], component[j]
                component = [new if c == old else c for c in component]
    least = {}
    for r, c in zip(rows, component, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    return [r for r in rows if r.doc_id in set(least.values())]


def test_pipeline_equals_brute_force(spark, tmp_path):
    path = str(tmp_path)
    write_tables(spark, path)
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    labelled = lambda name, columns: lambda rows: labelled_sample(docs.where(docs.doc_id.isin([r.doc_id for r in rows])), labels.selectExpr("doc_id", f"{name} AS y"), columns)
    start = docs.collect()
    rows = without_rejected(start, labelled("toxic", ["text"]), toxicity, toxic_score, 1, 0.7)
    rows = without_rejected(rows, labelled("quality", ["text", "n_chars"]), quality, quality_score, 0, 0.3)
    single = one_of_each_group(rows)
    assert len(start) > len(rows) > len(single) > 50  # each stage has something to do

    words = secrets.dictionary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    forest, wanted, redacted = secrets.trained(secrets.labelled_findings(words=words), words), set(), 0
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in single:
        text = r.text or ""
        for a, b, s in reversed(list(secrets._scan(text, r.source or "", forest, words))):
            if s >= secrets.KEEP:
                text, redacted = f"{text[:a]}[SECRET]{text[b:]}", redacted + 1
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for n, begin in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[begin : first if n == 0 else begin + 2048]
            wanted.add((r.doc_id, n, begin, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert redacted

    packed = __spark_entry__.queries()["pipeline"](spark, path).toPandas()
    found = list(packed[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    assert len(found) == len(wanted) and set(found) == wanted
    for _, part in packed.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 2048
    assert packed["sequence_id"].nunique() <= -(-packed["length"].sum() // 2048) + 1
