import duckdb
import pytest
from casewatch.llm import line_rules

PROSE = " ".join(f"w{i}" for i in range(60))


def run(spark, rows, **args):
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, n_words int")
    return {r.doc_id: r for r in line_rules.rules(docs, **args).collect()}


def test_base_measures(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", None), (4, "a b c a b c", "a"), (5, "x#*\nx#*\n\n \nX", "a"),
            (6, "é|ö <b>", "a"), (7, "a a a a a", "a"), (8, "\n".join([PROSE, PROSE]), "a")]
    got = run(spark, rows)
    pick = {d: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for d, r in got.items()}
    assert pick == {
        1: (0, 0, 0, 0, 0, True), 2: (0, 0, 0, 0, 0, True), 3: (0, 0, 0, 0, 0, True), 4: (6, 6, 0, 0, 6, True),
        5: (3, 7, 4, 1, 0, True), 6: (2, 6, 3, 0, 0, True), 7: (5, 5, 0, 0, 5, True), 8: (120, 340, 0, 1, 120, True)}


def test_shared_lines_are_removed_and_depleted_documents_rejected(spark):
    notice = " ".join(f"notice{i}" for i in range(40))
    own = lambda i, n: " ".join(f"d{i}x{j}" for j in range(n))
    rows = [(i, f"{notice}\n{own(i, 20)}", "h") for i in range(30)] + [(100 + i, f"{notice.upper()}\n{own(i, 70)}", "h") for i in range(3)]
    rows += [(200, f"{notice}\n{own(200, 20)}", "other"), (201, f"{notice}\n{own(201, 20)}", None)]
    rows += [(300 + i, own(300, 80) + "\n" + own(301, 10), "h") for i in range(40)]  # copies are one document
    got = run(spark, rows)
    assert not any(got[i].kept for i in range(30)) and all(got[i].n_removed_words == 40 for i in range(30))
    assert all(got[i].kept for i in (100, 101, 102, 200, 201, *range(300, 340)))


def test_every_line_of_a_shared_template_is_found(spark):
    line = lambda c, i: f"{c}{i} {c}{i + 1} {c}{i + 2}"
    for n, shared, own in ((30, 10, 3), (40, 5, 5), (60, 30, 1)):
        rows = [(d, "\n".join([line("s", i) for i in range(shared)] + [line(f"d{d}x", i) for i in range(own)]), "h") for d in range(n)]
        rows += [(n + d, rows[0][1], "other") for d in range(n)]  # copies are one document
        got = run(spark, rows)
        assert all(got[d].n_removed_words == (3 * shared if d < n else 0) for d in got)


def test_rows_and_columns_survive(spark):
    rows = [(1, PROSE, "a"), (1, PROSE, "a"), (None, PROSE, None), (3, "short", "a")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, k1 int")
    kept = line_rules.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.where("text <> 'short'").collect()))
    assert line_rules.rules(docs).count() == 4 and line_rules.rules(docs.limit(0)).count() == 0


def test_common_lines_leave_the_text(spark):
    own = [f"{PROSE.replace('w', f'd{i}x')}\n\n last  line {i} " for i in range(30)]
    rows = [(i, f"Read   our\tNOTICE\n{t}\nread our notice\nbye now", "h", 9) for i, t in enumerate(own)]
    rows += [rows[0], (50, f"read our notice\n{own[0]}", "other", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    kept = line_rules.kept_documents(docs)
    got = sorted((r.doc_id, r.text, r.n_chars) for r in kept.collect())
    assert kept.columns == docs.columns
    assert got == sorted([(i, t, len(t)) for i, t in enumerate(own)] + [(0, own[0], len(own[0])), (50, rows[-1][1], 9)])


def test_clashing_names_survive(spark):
    docs = spark.createDataFrame([(1, PROSE, "a", "x", "y", 5)], "doc_id long, text string, source string, __text string, ___host string, __k1 int")
    kept = line_rules.kept_documents(docs)
    assert kept.columns == docs.columns and kept.collect() == docs.collect()


line = lambda c, i: f"{c}{i} {c}{i + 1} {c}{i + 2}"
TEMPLATE = [(d, "\n".join([line("s", i) for i in range(10)] + [line(f"d{d}x", i) for i in range(40)]), "h") for d in range(30)]
COPIES = [(100 + d, TEMPLATE[d % 2][1].upper(), "other") for d in range(30)]
REPEATED = [(i, " ".join(f"w{(i * j * j) % 11}" for j in range(i)), f"s{i % 3}") for i in range(80)]


@pytest.mark.parametrize("rows, limit", [(REPEATED, 1), (TEMPLATE + COPIES, 20), (TEMPLATE + COPIES, 1)])
def test_sql_gives_the_same(spark, rows, limit):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    cursor = con.execute(line_rules.oracle(limit=limit))
    names = [d[0] for d in cursor.description]
    got = run(spark, rows, limit=limit)
    assert rows is REPEATED or any(r.n_removed_words for r in got.values())
    assert {r[0]: r for r in cursor.fetchall()} == {d: tuple(r[n] for n in names) for d, r in got.items()}
