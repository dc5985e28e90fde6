"""Stages and the whole pipeline on a small corpus."""

import hashlib
import itertools
import random
import zlib

import corpus_pipeline
from common import ODD, directory, docs, frame, smallest
from test_lines import brute as brute_lines
from tokenizers import Tokenizer

from farside.llm import bpe, mixing, simhash, toxicity


def made(rnd):
    word = lambda: "".join(rnd.choice(["an", "the", "ar", "en", "is", "ti", "in", "ea", "ha", "ch"]) for _ in range(rnd.randint(1, 4)))
    rows, labels = [], []
    for k in range(600):
        words = [word() + ("\n" if rnd.random() < 0.05 else " ") for _ in range(rnd.randint(20, 80))]
        toxic = int(k % 5 == 0)
        if toxic:
            words.insert(rnd.randint(0, len(words)), rnd.choice(["moron ", "worthless ", "stupid "]))
        text = "".join(words)
        rows.append((k, text, "en", f"src{k % 4}", len(text)))
        labels.append((k, 1, toxic))
    copies = [(1000 + k, *rows[1 + 10 * k][1:]) for k in range(20)]
    near = [(2000 + k, rows[2 + 10 * k][1].replace("the", "The", 1) + " end", *rows[2 + 10 * k][2:]) for k in range(20)]
    return [*rows, *copies, *near], labels


def test_pipeline(spark, tmp_path):
    rows, labels = made(random.Random(4))
    odd = [(i + 9000 if i is not None else None, *r) for i, *r in ODD]
    d = directory(tmp_path, documents=docs(spark, rows + odd), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = frame(corpus_pipeline.run(spark, d))
    ids = set(out.doc_id.dropna())
    assert len(out) == out.doc_id.nunique(dropna=False)
    bad = {i for i, _, y in labels if y}
    clean = {i for i, _, y in labels if not y}
    assert len(ids & bad) <= 2 and len(clean - ids) <= 5
    # exact copies lose all their lines and are then the same empty text
    assert len(ids & {1000 + k for k in range(20)}) <= 1
    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    first = next(r for r in rows if r[0] in ids and r[0] in clean)
    assert out[out.doc_id == first[0]].n_tokens.item() <= len(tokenizer.encode(first[1], add_special_tokens=False).ids)


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]
    rows = [(k, f"text number {k} with words of its own {k * 7919}", "en", f"src{k % 3}", 1) for k in range(30)]
    df = docs(spark, rows)
    d = directory(tmp_path, documents=df, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, d)
        assert out.columns == df.columns
    assert corpus_pipeline.run(spark, directory(tmp_path / "none", documents=df.limit(0), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_mixed_order_reaches_the_result(spark, tmp_path):
    rows = [(k, f"text number {k} " + " ".join(f"w{k * 31 + j}" for j in range(k % 40)), "en", f"src{k % 3}", 1) for k in range(400)]
    rows += [(None, f"without an id {k * 7919} {k}", "en", "src1", 1) for k in range(9)]
    df = docs(spark, rows).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        mixing.mixed(df).write.parquet(f"{tmp_path}/mixed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "mixed").glob("part-*"))) > 2
    out = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    hashed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(r.doc_id, hashed(r.text)) for r in mixing.mix(docs(spark, rows)).orderBy("position").collect()]
    assert [(r.doc_id, r.decoded_sha256) for r in out] == want and [r.position for r in out] == list(range(409))
    assert [r.source for r in out[:48]] == ["src0"] * 16 + [out[16].source] * 16 + [out[32].source] * 16 and {r.source for r in out[:112]} == {"src0", "src1", "src2"}
    # a table that is not made of files has the order of its partitions
    assert [r.position for r in mixing.in_order(docs(spark, rows[:50])).collect()] == list(range(50))


def test_every_stage_has_its_effect(spark, tmp_path, monkeypatch):
    """Without any one of the stages the result is another."""
    rows, labels = made(random.Random(5))
    rows += [(4000 + k, " ".join(rows[5 * k + 1][1].split()).replace(" ", "\n", 3) + " end", "en", "src1", 1) for k in range(8)]
    d = directory(tmp_path, documents=docs(spark, rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    stages = list(corpus_pipeline.STAGES)
    whole = [tuple(r) for r in corpus_pipeline.run(spark, d).collect()]
    for k in range(len(stages) - 1):
        monkeypatch.setattr(corpus_pipeline, "STAGES", stages[:k] + stages[k + 1 :])
        assert [tuple(r) for r in corpus_pipeline.run(spark, d).collect()] != whole, stages[k][0]
    assert not {"n_tokens", "position"} & set(stages[3][1](spark, docs(spark, rows), d).columns)


def slow(rows, labels):
    """All stages one after the other, in plain Python, over all pairs: [(doc_id, n_tokens, digest)] in the mixed order."""
    texts = {i: t for i, t, *_ in rows}
    known = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5]
    found = sorted(((texts[i], y) for i, y in known), key=lambda r: (r[1], r[0]))
    reader = toxicity.Reader(toxicity.fit([t for t, _ in found], [y for _, y in found]))
    for i in list(texts):
        words = toxicity.words_of(texts[i])
        reader.learn([words])
        if reader.score(words) >= 0.5:
            del texts[i]
    gone, _ = brute_lines(sorted(texts.items()))
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}
    texts = {i: t for i, t in left.items() if t.strip() or t == texts[i]}
    split = {i: t.encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in split.items()}
    prints = {i: simhash.fingerprint(t, 5) for i, t in texts.items()}
    near = []
    for a, b in itertools.combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if (prints[a] ^ prints[b]).bit_count() <= 2 or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            near.append((a, b))
    keep = set(smallest(near, list(texts)).values())
    source = {i: s for i, _, _, s, _ in rows}
    weights = {s: mixing.WEIGHTS.get(s, mixing.DEFAULT) for s in {source[i] for i in keep}}
    plan, out = mixing.period(weights), []
    turns = {s: [at for at, x in enumerate(plan) if x == s] for s in weights}
    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    for s, w in weights.items():
        own = sorted((i for i in keep if source[i] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        for rank, i in enumerate(own):
            block = rank // mixing.BLOCK
            slot = block // w * len(plan) + turns[s][block % w]
            ids = tokenizer.encode(texts[i], add_special_tokens=False).ids
            out.append((i, len(ids), hashlib.sha256(texts[i].encode()).hexdigest(), slot, slot * mixing.BLOCK + rank % mixing.BLOCK))
    return [r[:3] for r in sorted(out, key=lambda r: r[-1])], near


def test_like_a_slow_pipeline(spark, tmp_path):
    rows, labels = made(random.Random(11))
    rnd = random.Random(12)
    shared = "a notice that stands in many of these texts " * 3
    long = [f"{' '.join(rnd.choice('abcdefghijklm') * rnd.randint(2, 9) + str(rnd.randint(0, 99)) for _ in range(120))}" for _ in range(25)]
    more = [(3000 + k, f"{t}\n{shared}{k % 2}", "en", f"src{k % 4}", 1) for k, t in enumerate(long)]
    # lines that are near copies go; texts whose words are broken into other lines are near copies as wholes
    more += [(3100 + k, t.replace(" ", "\n", 60).replace("\n", " ", 57), "en", "src1", 1) for k, t in enumerate(long[:12])]
    more += [(3200 + k, " ".join(t.split()[:118]) + " new end", "en", "src2", 1) for k, t in enumerate(long[12:18])]
    rows = rows[:250] + rows[600:] + more
    rows = list({r[0]: r for r in rows}.values())
    labels = [x for x in labels if x[0] < 250]
    d = directory(tmp_path, documents=docs(spark, rows).repartition(4), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want, near = slow(rows, labels)
    got = [(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, d).collect()]
    assert len(near) > 5 and len(want) < len(rows) - 60
    assert got == want
