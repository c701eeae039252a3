import re
from collections import defaultdict

from fixtures import awkward, awkward_rows, empty
from peerscope.llm.line_dedup import count_lines, dedup_lines, line_hashes

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def brute(rows):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20 and doc_id is not None:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(holders.get(key(x), ())) < 3
                or max(holders[key(x)]) == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    got = [(r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"])
           for r in dedup_lines(awkward(spark)).collect()]
    want = brute([(r[0], r[1]) for r in awkward_rows()])
    assert sorted(got, key=str) == want and any(r[3] for r in want)


def test_runs_count_every_line_whatever_the_batches(spark):
    rows = [(i, "\n".join(f"line number {(i * j) % 17} of the shared text" for j in range(5))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_hashes(docs).cache()
    counts = [sorted(map(tuple, count_lines(lines, batches, fan_in).collect()))
              for batches, fan_in in ((1, 2), (4, 2), (7, 3))]
    assert counts[0] == counts[1] == counts[2] and counts[0]


def test_no_python_on_the_path(spark):
    plan = dedup_lines(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert dedup_lines(empty(spark)).count() == 0
