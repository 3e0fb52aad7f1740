"""Sources read by ranges: against a plain parse of whole files, at many range sizes."""

import gzip
import json
import random
import re

import pytest

from inkstone.sources import tables as IO

RULER = "=" * 100


def plainly(text):
    """Records of one file's whole text."""
    text = text.removeprefix("﻿")
    starts = [m.start() for m in re.finditer(r"(?m)^DOC_ID:", text)]
    out = []
    for a, b in zip(starts, [*starts, len(text)][1:], strict=True):
        lines = text[a:b].split("\n")
        head, body = {}, 0
        for k, line in enumerate(lines[:12]):
            for name in ("DOC_ID", "FILENAME", "PAGES", "EXTRACTED_WORDS"):
                if line.startswith(f"{name}:"):
                    head.setdefault(name, line.split(":", 1)[1].strip(" \t\r"))
        for k, line in enumerate(lines):
            if k and line.startswith("EXTRACTED_WORDS:"):
                body = k + 1
                break
        number = lambda x: int(x) if x.isdigit() else 0
        out.append((head.get("DOC_ID", ""), head.get("FILENAME", ""), number(head.get("PAGES", "")), number(head.get("EXTRACTED_WORDS", "")), "\n".join(lines[body:]).strip(" \t\n\r\x0b\x0c")))
    return out


def block(i, body):
    return f"{RULER}\nDOC_ID: D{i}\nFILENAME: f{i}.pdf\nPAGES: {i % 7}\nEXTRACTED_WORDS: {len(body.split())}\n{RULER}\n{body}\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A large file, and small ones that begin in all ways that a file may begin."""
    folder = tmp_path_factory.mktemp("blocks")
    rng = random.Random(2)
    bodies = ["", "one line", "DOC_ID in a line, and a DOC_ID: too", "é 日本\n\nlast", "\n\nDOC_I", "x" * 900]
    texts = {
        "large": "".join(block(i, rng.choice(bodies) + " w" * rng.randint(0, 40)) for i in range(120)), "bare": "DOC_ID: D900\nno header\n", "bom": "﻿" + "DOC_ID: D901\nFILENAME: b\nEXTRACTED_WORDS: 1\nbody",
        "late": "some words before\nand more\n" + block(902, "body"), "blank": "\n" + "DOC_ID: D903\nEXTRACTED_WORDS: 0\n", "none": "no record at all\n", "empty": "", "windows": block(904, "body\nof lines").replace("\n", "\r\n"),
        "deep": "DOC_ID: D905\n" + "pad\n" * 20 + "FILENAME: too late\nEXTRACTED_WORDS: 5\nbody",
    }
    for name, text in texts.items():
        (folder / f"{name}.txt").write_bytes(text.encode())
    with gzip.open(folder / "packed.txt.gz", "wb") as f:
        f.write("".join(block(950 + i, f"body {i}") for i in range(5)).encode())
    texts["packed"] = "".join(block(950 + i, f"body {i}") for i in range(5))
    return str(folder), texts


@pytest.mark.parametrize("size", [61, 100, 107, 108, 109, 256, 1000, 4099, 1 << 27])
def test_records_at_every_range_size(spark, files, size):
    path, texts = files
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = IO.read_records(spark, path)
        got = sorted(map(tuple, rows.collect()))
        tasks = IO.record_blocks(spark, f"{path}/large.txt").rdd.getNumPartitions()
    finally:
        for k in keys:
            spark.conf.unset(k)
    want = sorted(r for t in texts.values() for r in plainly(t))
    assert [r[:2] for r in got] == [r[:2] for r in want] and got == want
    assert tasks > 10 if size < 1100 else True


def test_files_without_records(spark, tmp_path):
    (tmp_path / "a.txt").write_text("nothing")
    assert IO.read_records(spark, str(tmp_path)).count() == 0


def test_json_lines_by_ranges(spark, tmp_path):
    rows = [{"doc_id": f"J{i}", "filename": f"n{i}", "text": "w " * (i % 50) + "é\nü"} for i in range(300)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.jsonl").write_bytes(("﻿" + "\n\n".join(map(json.dumps, rows[:200])) + "\n").encode())
    with gzip.open(tmp_path / "j" / "b.jsonl.gz", "wb") as f:
        f.write("\n".join(map(json.dumps, rows[200:])).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        out = IO.json_lines(spark, str(tmp_path / "j"))
        got, tasks = sorted((r["doc_id"], r["filename"], r["text"]) for r in out.collect()), out.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((r["doc_id"], r["filename"], r["text"]) for r in rows) and tasks > 4


def graph(spark):
    nodes = spark.createDataFrame([("a", 'A & <b> "q"', 1.5, 3, True, None), ("b", "two\nlines ", None, None, None, ""), ("ü", "", -2.0, 0, False, "x")], "id string, label string, weight double, n long, ok boolean, note string")
    edges = spark.createDataFrame([("a", "b", "r", "rule", 1.0), ("a", "ü", "r", "rule", 0.25), ("b", "a", "s", "fixed", None)], "source string, target string, relation string, origin string, weight double")
    return nodes, edges


def test_graphml_is_one_file_of_many_parts_and_comes_back(spark, tmp_path):
    import xml.etree.ElementTree as ET

    nodes, edges = graph(spark)
    path = f"{tmp_path}/g.graphml"
    IO.write_graphml(nodes, edges, path)
    root = ET.parse(path).getroot()  # a standard reader
    names = {k.get("attr.name"): k.get("attr.type") for k in root.iter("{http://graphml.graphdrawing.org/xmlns}key") if k.get("for") == "node"}
    assert names == {"label": "string", "weight": "double", "n": "long", "ok": "boolean", "note": "string"}
    assert [n.get("id") for n in root.iter("{http://graphml.graphdrawing.org/xmlns}node")] == ["a", "b", "ü"]
    assert not (tmp_path / "g.graphml.parts").exists()
    back = IO.read_graphml(spark, path)
    got = {r["id"]: tuple(r)[1:] for r in back[0].collect()}
    assert got["a"] == ('A & <b> "q"', 1.5, 3, True, "") and got["ü"] == ("", -2.0, 0, False, "x") and got["b"][1:4] == (None, None, None)
    assert sorted(map(str, back[1].collect())) == sorted(map(str, edges.collect()))
    from inkstone.operators import graph as H

    assert all(r["failures"] == 0 for r in H.export_validation(nodes, edges, *back, "graphml").collect())


def test_graphml_is_read_by_ranges_of_the_file(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{k:03}", "two\nlines" if k == 7 else "a > b & c") for k in range(200)], "id string, label string")
    edges = spark.createDataFrame([(f"n{k:03}", "n000", "r", float(k)) for k in range(1, 200)], "source string, target string, relation string, weight double")
    path = f"{tmp_path}/g.graphml"
    IO.write_graphml(nodes, edges, path)
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, "4096")
    try:
        back = IO.read_graphml(spark, path)
        assert min(x.rdd.getNumPartitions() for x in back) > 4
        assert sorted(map(tuple, back[0].collect())) == sorted(map(tuple, nodes.collect()))
        assert sorted(map(tuple, back[1].collect())) == sorted(map(tuple, edges.collect()))
        # elements of several lines, several on a line, or in a comment, are those of a reader of whole files
        text = open(path).read().replace('"><data', '">\n  <data').replace("</node>\n<node", "</node><node").replace("<graph ", '<!--\n<node id="no"/>\n--><graph ')
        open(f"{tmp_path}/other.graphml", "w").write(text)
        other = IO.read_graphml(spark, f"{tmp_path}/other.graphml")
        assert sorted(map(tuple, other[0].collect())) == sorted(map(tuple, nodes.collect())) and other[1].count() == 199
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)


@pytest.mark.parametrize("check", ["nodes agree", "edges agree", "ends of edges are nodes", "node ids are unique", "edge keys are unique", "origins agree", "node attributes agree", "edge attributes agree", "no node attribute is missing", "no edge attribute is missing", "numbers of nodes and edges agree"])
def test_each_export_check_can_fail(spark, check):
    from pyspark.sql import functions as F

    from inkstone.operators import graph as H

    nodes, edges = graph(spark)
    other = {
        "nodes agree": (nodes.filter("id <> 'ü'"), edges), "edges agree": (nodes, edges.withColumn("relation", F.lit("t"))), "ends of edges are nodes": (nodes, edges.withColumn("target", F.lit("gone"))),
        "node ids are unique": (nodes.union(nodes), edges), "edge keys are unique": (nodes, edges.union(edges)), "origins agree": (nodes, edges.withColumn("origin", F.lit("rule"))),
        "node attributes agree": (nodes.withColumn("n", F.col("n") + 1), edges), "edge attributes agree": (nodes, edges.withColumn("weight", F.lit(9.0))), "no node attribute is missing": (nodes.drop("n"), edges),
        "no edge attribute is missing": (nodes, edges.drop("weight")), "numbers of nodes and edges agree": (nodes, edges.limit(2)),
    }[check]
    failed = {r["check"].removeprefix("x: ") for r in H.export_validation(nodes, edges, *other, "x").collect() if r["failures"]}
    assert check in failed


def test_canonical_files_depend_on_the_rows_alone(spark, tmp_path):
    rows = [(i, f"t{i % 7}", None if i % 5 else i / 3) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string, x double")
    digests = lambda frame, name, order=("text",): [(r["part"], r["sha256"]) for r in (IO.write_canonical(frame, order, f"{tmp_path}/{name}", 3), IO.file_digests(spark, f"{tmp_path}/{name}").orderBy("part"))[1].collect()]
    first = digests(df, "a")
    assert len(first) == 3 and digests(df.repartition(5, "id").select("x", "id", "text"), "b") == first
    assert digests(df.withColumn("x", df["x"] + 1e-9), "c") != first  # a value
    assert digests(df, "d", ("id",)) != first  # an order
    assert digests(df.limit(99), "e") != first
    runs = iter((df, df.repartition(2), df, df.withColumn("id", df["id"] + 1)))
    out = IO.reruns_identical(spark, lambda: {"same": (next(runs), ["id"])}, f"{tmp_path}/r", 2)
    assert all(r["agree"] for r in out.collect())
    other = IO.reruns_identical(spark, lambda: {"unlike": (next(runs), ["id"])}, f"{tmp_path}/s", 2)
    assert not any(r["agree"] for r in other.collect())


def test_requests_are_asked_once(spark, tmp_path):
    """A worker that dies midway: what was answered by then is not asked again."""
    requests = spark.createDataFrame([(k, f"h{k:02d}", f"prompt {k}") for k in range(12)] + [(99, "h03", "prompt 3")], "batch long, request_sha256 string, prompt string")
    calls, broken, path = tmp_path / "calls", tmp_path / "broken", f"{tmp_path}/answers"
    broken.write_text("yes")

    def generate(prompt):
        import os
        import time

        with open(calls, "a") as f:
            f.write(prompt + "\n")
        if prompt == "prompt 9" and broken.exists():
            time.sleep(2)
            os._exit(1)
        return {"done": prompt != "prompt 5" or not broken.exists(), "done_reason": "stop", "response": f"answer to {prompt}"}

    with pytest.raises(Exception):  # noqa: B017  the job fails with its task
        IO.ask(requests, generate, path, wait=0.0)
    whole = {r["request_sha256"] for r in spark.read.parquet(path).filter("done").collect()}
    assert 4 <= len(whole) < 12 and "h05" not in whole
    broken.unlink()
    calls.write_text("")
    out = IO.ask(requests, generate, path, wait=0.0)
    asked = calls.read_text().split("\n")[:-1]
    assert len(asked) == len(set(asked)) and {f"h{int(p.split()[1]):02d}" for p in asked} == {f"h{k:02d}" for k in range(12)} - whole
    assert sorted(r["request_sha256"] for r in out.filter("done").collect()) == [f"h{k:02d}" for k in range(12)]
    calls.write_text("")
    assert IO.ask(requests, generate, path, wait=0.0).count() == out.count() and not calls.read_text()
    assert IO.ask(requests.limit(0), generate, f"{tmp_path}/none").count() == 0


def test_audit_counts_headings(spark):
    texts = ["1. one\n## 2. two\n  3. three\nnot 4. here\n5 no\n#6. six", "", "12. twelve\n1.none"]
    responses = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "batch long, response string")
    members = spark.createDataFrame([(k, [1, 2]) for k in range(3)], "batch long, members array<long>")
    got = {r["batch"]: (r["headings"], r["own"]) for r in IO.response_audit(responses, members).collect()}
    assert got == {k: (len(re.findall(r"(?m)^\s*(?:#+\s*)?\d\.\s", t)), len({"1", "2"} & set(re.findall(r"\b(\d+)\b", t)))) for k, t in enumerate(texts)}
