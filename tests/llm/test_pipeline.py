import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tests.llm.test_jaccard_join import brute as near_brute
from tests.llm.test_secret_ownership import brute as secret_brute
from tests.llm.test_string_kernel import made
from tests.llm.test_wu_manber import brute as leak_brute


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    items = [(i, made(rng, "bb")) for i in range(8)]
    rows = []
    for i in range(160):
        lang = rng.choice(["aa", "bb", "cc"])
        text = made(rng, lang)
        if i % 9 == 0:
            text += "\n" + items[i % 8][1]
        if i % 7 == 0:
            text += f' password = "hunter{i}x" end'
        if i % 5 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1] + rng.choice(["", " tail"])
        rows.append((i, text, lang, f"s{i % 6}", len(text)))
    rows += [(200, None, "aa", "s1", 0), (201, "", None, None, None), (202, "12 34", "bb", "s1", 5), (3, rows[3][1], "aa", "s1", 7), (None, "only here " + made(rng, "cc"), None, "s2", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.dtypes == spark.createDataFrame([], names).dtypes
        stages.append(sorted(map(tuple, docs.collect()), key=str))
    spoken, single, clean, masked = stages
    assert len(spoken) == 162 and not {200, 201, 202} & {r[0] for r in spoken}  # clean rows stay as they are
    assert set(spoken) <= set(rows)
    groups = near_brute([r[:2] for r in spoken])
    assert len(single) == len({(c if c is not None else t) for (_, _, c), (_, t, *_) in zip(groups, spoken)})
    assert sorted(r[0] for r in single if r[0] is not None) == sorted({c for _, _, c in groups if c is not None})
    hits = leak_brute([r[1] for r in single], items)
    assert clean == [r for r, (_, n, _) in zip(single, hits) if not n]
    want = []
    for i, t, lang, source, n in clean:
        for _, s, e in reversed(secret_brute(t)):
            t = t[:s] + "[secret]" + t[e:]
        want.append((i, t, lang, source, len(t) if "[secret]" in t else n))
    assert masked == sorted(want, key=str) and any("[secret]" in r[1] for r in masked)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(setting, before := str(9 << 20))
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert spark.conf.get(setting) == before
    got = sorted(map(tuple, last.collect()), key=str)
    want = []
    for i, t, *_ in masked:
        ids = coder.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str) and re.match("^doc_id", last.columns[0])


def test_empty_tables_and_columns_beyond_the_five(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], names).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    rng = random.Random(2)
    rows = [(i, made(rng, "aa" if i % 2 else "bb"), "aa" if i % 2 else "bb", "s", 3, "p", 1.0) for i in range(80)] + [(90, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, names + ", lang_pred string, kept_text double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, f"{tmp_path}/a")
        assert got.columns == list(corpus_pipeline.COLUMNS) and 60 <= got.count() <= 81
