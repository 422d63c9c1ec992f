import hashlib
import random

from loomgraph.llm.lines import Params, dedup_lines, later_copies, report

SCHEMA = "doc_id long, text string, n_chars long, mark string, removed int"


def brute(rows, least):
    """Deleted (doc, line): of every run of worded lines with enough words that occurs earlier, what is beyond the first copy."""
    seqs = {d: [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate((t or "").split("\n")) if x.split()] for d, t in rows}
    first, gone = {}, set()
    spans = []
    for d in sorted(seqs):
        s = seqs[d]
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                run = tuple(x for _, x in s[a:b])
                if sum(len(x.split()) for x in run) >= least:
                    first.setdefault(run, (d, a))
                    spans.append((d, a, b, run))
    for d, a, b, run in spans:
        f = first[run]
        if f != (d, a):
            begin = max(a, f[1] + b - a) if f[0] == d else a
            gone |= {(d, s) for s, _ in seqs[d][begin:b]}
    return gone


def made(spark, rows):
    return spark.createDataFrame([(d, t, len(t or ""), "m", 1) for d, t in rows], SCHEMA)


def test_deletions_are_those_of_brute_force(spark):
    draw = random.Random(3)
    lines = ["a b c", "d e", "f", "g h i j", "k l", "m n o", ""]
    rows = [(d, "\n".join(draw.choice(lines) if draw.random() < 0.7 else f"own {d} {i}" for i in range(draw.randint(0, 9)))) for d in range(40)]
    rows += [(50, rows[3][1]), (51, None), (52, ""), (53, "a b c\n" * 12), (54, "x y z w v u\n\nt s r q"), (55, "x y z w v u\nt s r q")]
    got = {(r["doc_id"], line) for r in later_copies(made(spark, rows), Params(8)).collect() for line in r["removed"]}
    assert got == brute(rows, 8)


def test_dedup_keeps_clean_documents_and_columns(spark):
    long = "one two three four five six"
    rows = [(1, f"{long}\nkept here"), (2, f"other\n{long}\nend"), (3, long), (4, "clean text"), (5, None), (6, ""), (None, long)]
    got = {r["doc_id"]: r for r in dedup_lines(made(spark, rows), Params(6)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "other\nend" and got[2]["n_chars"] == 9
    assert 3 not in got and got[4]["text"] == "clean text" and got[5]["text"] is None and got[6]["text"] == ""
    assert got[None]["text"] == long and got[2]["mark"] == "m" and got[2]["removed"] == 1


def test_rows_that_repeat_are_one_document(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f")]
    assert later_copies(made(spark, rows), Params(6)).count() == 0


def test_report_and_empty_table(spark):
    got = report(made(spark, [(1, "a b c"), (2, "a b c\nx")]), Params(3)).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_removed"]) for r in got] == [(1, 0), (2, 1)]
    assert got[1]["kept_sha256"] == hashlib.sha256(b"x").hexdigest()
    assert report(made(spark, [])).count() == 0 and dedup_lines(made(spark, [])).count() == 0
