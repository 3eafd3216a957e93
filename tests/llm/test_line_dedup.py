from awkward import ROWS, documents, empty

from termspire.llm import line_dedup
from termspire.plans import staging


def brute(rows, ratio, least):
    pages, seen = {}, {}
    for _, host, text in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            seen[host, line] = seen.get((host, line), 0) + 1
    made = []
    for key, host, text in rows:
        lines = [] if text is None else text.split("\n")
        gone = [seen.get((host, x.strip(" ")), 0) >= least and seen[host, x.strip(" ")] > ratio * pages[host] for x in lines]
        left = [x for x, g in zip(lines, gone, strict=True) if not g]
        made.append((key, host, len(lines), sum(gone), None if text is None else "\n".join(left)))
    return made


def test_one_ratio_at_every_size(spark):
    """A line on more than a tenth of the pages goes, on hosts of three pages as on one of a thousand."""
    rows = []
    for pages in (1, 3, 9, 19, 21, 1000):
        held = pages // 10 + 1
        for n in range(pages):
            common = "common" if n < held or pages == 1 else f"other {n}"
            rows.append((len(rows), f"h{pages}", f"{common}\nnearly {n % 11}\nown {n}"))
    frame = spark.createDataFrame(rows, "doc_id int, source string, text string")
    found = rows_of(line_dedup.line_dedup(frame))
    assert found == sorted(brute(rows, 0.1, 2), key=repr)
    gone = {r.host for r in line_dedup.line_dedup(frame).where("n_dropped > 0").collect()}
    assert gone == {"h19", "h21", "h1000"}


def test_copies_are_pages(spark):
    frame = spark.createDataFrame(sample(), "doc_id int, source string, text string")
    found = {r.doc_id: r for r in line_dedup.line_dedup(frame).collect()}
    assert all(found[200 + n].text == "" and found[200 + n].n_dropped == 2 for n in range(40))


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def sample():
    rows = [(n, "big" if n % 3 else "small", f" common \nline {n}\n\nrare {n % 9}\ncommon") for n in range(60)]
    rows += [(200 + n, "big", "copied line one\ncopied line two") for n in range(40)]
    return rows + [(100, None, "common\ncommon"), (101, None, None), (102, "big", ""), (1, "big", "line 1\n")]


def test_agrees_with_brute_force_with_and_without_broadcast(spark, monkeypatch):
    frame = spark.createDataFrame(sample(), "doc_id int, source string, text string")
    expected = sorted(brute(sample(), 0.1, 2), key=repr)
    assert rows_of(line_dedup.line_dedup(frame)) == expected
    monkeypatch.setattr(staging, "MAX_BROADCAST_ROWS", 0)
    assert rows_of(line_dedup.line_dedup(frame)) == expected


def test_columns_stay(spark):
    docs = documents(spark)
    left = line_dedup.drop_lines(docs, ratio=0.2, min_pages=2)
    assert left.schema == docs.schema and left.count() == docs.count()
    for row in left.collect():
        if row.text is not None:
            assert row.n_chars == len(row.text)
    assert rows_of(line_dedup.drop_lines(docs, ratio=1.0)) == rows_of(docs)


def test_awkward_rows(spark):
    docs = documents(spark)
    hosts = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    found = line_dedup.line_dedup(docs, ratio=0.2, min_pages=2)
    assert rows_of(found) == sorted(brute(hosts, 0.2, 2), key=repr)
    assert len(hosts) == len(ROWS)
    assert line_dedup.line_dedup(empty(spark)).count() == 0
