import random
import zlib

import duckdb
import numpy as np
from casewatch.llm import direct_codes as dac
from casewatch.session import scratch

SF = "/root/testdata/sf0.001/documents.parquet"


def reader(blob):
    asked = []

    def read(at, size):
        asked.append(size)
        return blob[at : at + size]

    return dac.Codes(read), asked


def test_any_id_and_any_run_come_back():
    rng = random.Random(3)
    ids = [np.array([rng.choice([0, 1, 255, 256, 65_535, 65_536, 2**32 - 1, rng.randrange(2**20)]) for _ in range(n)], np.uint32)
           for n in (0, 1, 700, 5000, 3)]
    flat = np.concatenate(ids)
    codes, asked = reader(dac.pack([None, 5, 6, 7, 9], ids))
    assert codes.documents()[0] == [None, 5, 6, 7, 9]
    assert codes.documents()[1].tolist() == [0, 0, 1, 701, 5701, 5704]
    assert [codes[i] for i in range(0, len(flat), 37)] == flat[::37].tolist()
    for _ in range(200):
        a = rng.randrange(len(flat) + 1)
        b = rng.randrange(a, len(flat) + 1)
        assert codes.run(a, b).tolist() == flat[a:b].tolist()
    asked.clear()
    assert codes[5000] == flat[5000] and sum(asked) < 4 * 100  # one code, at most a block of bits and a rank a level


def test_empty_file():
    codes, _ = reader(dac.pack([], []))
    assert len(codes) == 0 and codes.documents()[0] == []


def wanted(rows):
    from tokenizers import Tokenizer

    coder, at, out = Tokenizer.from_file(dac.default_vocabulary()), 0, []
    for doc, text in rows:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_all_documents_against_the_library(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}' ORDER BY doc_id").fetchall()
    out = dac.write_and_read(spark.read.parquet(SF))
    assert sorted(tuple(r) for r in out.collect()) == wanted(rows)


def test_edge_rows(spark):
    rows = [(None, "B a"), (-4, None), (2, ""), (7, "Ünï <|endoftext|> x"), (7, "Ünï <|endoftext|> x"), (9, "w" * 20_000)]
    docs = spark.createDataFrame([(*r, 1) for r in reversed(rows)], "doc_id long, text string, start long")
    got = sorted((tuple(r) for r in dac.write_and_read(docs).collect()), key=lambda r: r[1])
    assert got == wanted(rows)
    assert dac.write_and_read(docs.limit(0)).count() == 0


def test_small_buckets_keep_the_order(spark):
    rows = [(i * 7 % 101, f"w{i} " * (i % 9)) for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = dac.write(docs, scratch(spark, "ids"), target=64)
    assert manifest.count() > 4
    assert sorted(tuple(r) for r in dac.read(manifest).collect()) == wanted(sorted(rows))


def test_case_and_punctuation_cost_no_further_call_of_the_library():
    coder, asked = dac.WordCoder(dac.default_vocabulary()), []

    class Library:
        def encode_batch(self, groups, library=coder.coder, **args):
            asked.extend(w for group in groups for w in group)
            return library.encode_batch(groups, **args)

    library, coder.coder = coder.coder, Library()
    texts = ["Wörd wörd, WÖRD!! wörd...", "", " \t", "İstanbul ΣΑΣ don't it's! a_b x9y (z) é ÷a <|endoftext|> 's", "He's. A' \x1cb \x85", "wörd,"]
    got = coder([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [w for w in asked if "ö" in w.lower()] == ["wörd"] and len(asked) == len(set(asked))
    assert coder([b""]) == [b""] and coder.column([b"", b" "], b"\1\0\0\0").to_pylist() == [b"\1\0\0\0"] * 2


def test_a_vocabulary_with_other_rules_gets_words_as_they_stand(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    library = Tokenizer(models.WordLevel({"A": 0, "a": 1, "a.": 2, "?": 3}, unk_token="?"))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    library.save(str(tmp_path / "words.json"))
    coder = dac.WordCoder(str(tmp_path / "words.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in coder([b"A a a.  b", b""])] == [[0, 1, 2, 3], []]
