import random

import duckdb
import pyarrow as pa
import pytest
from casewatch.llm import pieces

SF = "/root/testdata/sf0.001/documents.parquet"


def _varint(b, i):
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _put(value):
    out = b""
    while True:
        out += bytes([value & 127 | (128 if value > 127 else 0)])
        value >>= 7
        if not value:
            return out


def as_unigram(raw):
    """The model file with its type set to unigram and without the huge penalties of space runs."""
    import struct

    out, i = b"", 0
    while i < len(raw):
        key, i = _varint(raw, i)
        size, i = _varint(raw, i)
        body, i = raw[i : i + size], i + size
        if key >> 3 == 1:
            j, piece = 0, b""
            while j < len(body):
                k, at = _varint(body, j)
                if k & 7 == 2:
                    n, at = _varint(body, at)
                    end = at + n
                elif k & 7 == 5:
                    end = at + 4
                    if struct.unpack("<f", body[at:end])[0] < -1e8:
                        piece += body[j:at] + struct.pack("<f", -40000.0)
                        j = end
                        continue
                else:
                    end = _varint(body, at)[1]
                piece += body[j:end]
                j = end
            body = piece
        elif key >> 3 == 2:
            body = body.replace(b"\x18\x02", b"\x18\x01", 1)
        out += _put(key) + _put(len(body)) + body
    return out


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    from sentencepiece import SentencePieceProcessor

    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(as_unigram(open(pieces.default_model(), "rb").read()))
    return SentencePieceProcessor(model_file=str(path)), pieces.PieceModel.load(str(path))


def test_ids_equal_the_library(library):
    sp, own = library
    for (text,) in duckdb.sql(f"SELECT text FROM '{SF}' ORDER BY doc_id LIMIT 60").fetchall():
        assert own.encode(text).tolist() == sp.encode(text)
    for text in ["", " ", "  a  b ", "one\n\ntwo", "tab\tand emoji 😀 x", "naïve café 日本語", "a" * 50, "x▁y"]:
        assert own.encode(text).tolist() == sp.encode(text), text


def test_streaming_equals_whole_search(library):
    _, own = library
    rng = random.Random(1)
    for _ in range(20):
        text = "".join(rng.choice("thand ▁eringo\nß日") for _ in range(rng.randint(0, 3000)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(9))
        blocks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        assert [*own.search(blocks)] == [*own.search([text])]


def test_state_is_a_window(library):
    _, own = library
    rng, seen = random.Random(2), []
    text = "".join(rng.choice("thandering") for _ in range(60_000))
    own_trace = own.trace
    own.trace = lambda t, back, to: seen.append(len(t)) or own_trace(t, back, to)
    try:
        ids = [*own.search(text[i : i + 100] for i in range(0, len(text), 100))]
    finally:
        del own.trace
    assert max(seen) < 2000
    assert own.decode(ids).decode() == text


def test_digest_over_edge_rows(spark):
    rows = [(1, "The cat\nsat  down"), (2, None), (3, ""), (None, "x y"), (1, "The cat\nsat  down"), (4, "w" * 30_000), (5, "😀 \U0001f600")]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, ids string")
    out = pieces.digest(docs)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert len(got) == len(rows) and all(r[4] for r in got)
    assert {r[1] for r in got if r[0] in (2, 3)} == {0}
    assert pieces.digest(docs.limit(0)).count() == 0


def test_restores_every_document(spark):
    docs = spark.read.parquet(SF)
    out = pieces.digest(docs)
    assert out.where("restored").count() == docs.count()


def test_idle_workers_remember_nothing(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('word', id, ' and w', id * 7) AS text").repartition(4)
    assert pieces.digest(docs).where("restored").count() == 400
    path = pieces.default_model()

    def held(batches):
        for batch in batches:
            memo = pieces.model(path).memo
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(memo) + len(memo.old)], pa.int64())})

    assert spark.range(0, 32, 1, 16).mapInArrow(held, "n long").agg({"n": "max"}).first()[0] == 0


def test_short_texts_equal_all_segmentations():
    """Words are searched letter by letter along the pieces; against every way to cut them, ties and unknown letters included."""
    rng = random.Random(3)

    def best(own, text):
        if not text:
            return 0.0, []
        found = []
        for n in range(1, min(own.longest, len(text)) + 1):
            last = text[-n:]
            if last in own.table or n == 1:
                score, cut = best(own, text[:-n])
                found.append((score + (own.table[last][1] if last in own.table else own.unknown_score), n, cut + [last]))
        score, _, cut = max(found)  # the longer last piece keeps ties
        return score, cut

    for _ in range(30):
        words = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 12))}
        own = pieces.PieceModel([("?", 0.0, "unknown"), *((w, float(-rng.randint(0, 4)), "normal") for w in sorted(words))])
        for text in ["", *("".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(20))]:
            want = [i for p in best(own, text)[1] for i in own.ids(p)]
            assert [*own.whole(text)] == want == [*own.search((text,))]
