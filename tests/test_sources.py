"""CSV files sound and broken, inventories by first bytes, pages of any brokenness, exact ranks."""

import csv as python_csv
import io
import os
import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import evaluation, ingest
from lodestone.sources import csv, files


def put(folder, **named):
    folder.mkdir(exist_ok=True)
    for name, data in named.items():
        (folder / f"{name}.csv").write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def test_sound_files(spark, tmp_path):
    path = put(tmp_path / "in", a='﻿id, name ,when,odd\r\n1,"x, ""y""\nz",2024-01-02,1\n2,,2024-02-30,x\n', b="id,name,when,odd\n3,q,2024-01-03,\n")
    rows = csv.read_csv_strict(spark, path)
    assert rows.columns == ["_file", "_row", "id", "name", "when", "odd"]
    assert sorted(tuple(r)[1:] for r in rows.collect()) == [(1, "1", 'x, "y"\nz', "2024-01-02", "1"), (1, "3", "q", "2024-01-03", None), (2, "2", None, "2024-02-30", "x")]
    assert {r.column: r.type for r in csv.infer_types(rows.drop("_file", "_row")).collect()} == {"id": "integer", "name": "text", "when": "text", "odd": "text"}
    kinds = spark.createDataFrame([("true", "1.5", "2024-01-01T10:00:00Z", "2024-01-01", None), ("NO", "-2", "2024-01-01 10:00", "1999-12-31", None)], "a string, b string, c string, d string, e string")
    assert {r.column: r.type for r in csv.infer_types(kinds).collect()} == {"a": "boolean", "b": "decimal", "c": "datetime", "d": "date", "e": "text"}
    assert sorted(map(tuple, csv.preview(rows.drop("_file", "_row").filter("id < 3"), ["id"], 1).collect())) == [("name", "text", 2, ['x, "y"\nz']), ("odd", "text", 2, ["1"]), ("when", "text", 2, ["2024-01-02"])]


FAULTS = {
    "empty": ("", [(-1, "empty")]),
    "header_only": ("a,b\n", [(-1, "no_rows")]),
    "no_values": ("a,b\n,\n,\n", [(-1, "no_values")]),
    "blank": ("a,,c\n1,2,3\n", [(0, "blank_header")]),
    "doubled": ("a,b, a\n1,2,3\n", [(0, "doubled_header")]),
    "counts": ('a,b\n1\n1,2\n1,2,3\n\n"x\ny",2\n', [(1, "field_count"), (3, "field_count"), (4, "field_count")]),
    "quotes": ('a,b\n1,"x"y\n2,z\n', [(1, "malformed")]),
    "open": ('a,b\n1,2\n3,"never closed\n4,5\n', [(2, "malformed")]),
    "bytes": (b"a,b\n1,\xff\n", [(-1, "encoding")]),
    "null_byte": ("a,b\n1,\x00\n", [(-1, "null_byte")]),
    "long": ("a,b\n1,xxxxxxxxxxxxx\n2,y\n", [(1, "long_field")]),
    "many": ("a,b\n" + "1,2\n" * 8, [(-1, "too_many_rows")]),
    "wide": ("a,b,c,d,e\n1,2,3,4,5\n", [(0, "too_many_columns")]),
    "large": ("a,b\n" + "1,2222222222\n" * 90, [(-1, "too_large")]),
    "sound": ("a,b\n1,2\n", []),
}


def test_every_fault_is_reported_and_none_fails_the_query(spark, tmp_path):
    path = put(tmp_path / "in", **{k: v for k, (v, _) in FAULTS.items() if v})
    (tmp_path / "in" / "other.txt").write_text("a,b\n1,2\n")
    found = csv.csv_records(spark, path, csv.Contract(most_bytes=1000, most_rows=7, most_columns=4, longest=12))
    got = {}
    for r in csv.csv_faults(found).collect():
        got.setdefault(os.path.basename(r.file).rsplit(".", 1)[0], []).append((r.row, r.rule))
    assert {k: sorted(v) for k, v in got.items()} == {**{k: v for k, (_, v) in FAULTS.items() if v and k != "empty"}, "other": [(-1, "extension")]}
    verdicts = {os.path.basename(r.file): (r.accepted, r.rows) for r in csv.csv_verdicts(found).collect()}
    assert {k for k, v in verdicts.items() if v[0]} == {"sound.csv"} and verdicts["counts.csv"] == (False, 2)
    assert [tuple(r)[1:] for r in csv.read_csv_strict(spark, path, ["a", "b"], csv.Contract(1000, 7, 4, 12)).collect()] == [(1, "1", "2")]
    assert list(csv.records(b"", csv.Contract())) == [(-1, "empty", "no header", None)]


def test_files_keep_to_the_contract(spark, tmp_path):
    rng = random.Random(5)
    limits = csv.Contract(most_bytes=2000, most_rows=9, longest=1500)
    odd = [' a ', 'x\ry', 'q"\\', None, "\t", "a,b\r\nc", "", "é\u2028", '"' * 700, "ß" * 900]
    rows = [(i, rng.choice(odd[:-2]) if i % 40 else odd[-1 - i // 40 % 2]) for i in range(400)] + [(None, "same")] * 50
    csv.write_csv(spark.createDataFrame(rows, "`a.b` long, c string").repartition(3), f"{tmp_path}/out", limits)
    found = csv.csv_records(spark, f"{tmp_path}/out", limits)
    verdicts = csv.csv_verdicts(found).collect()
    assert 50 <= len(verdicts) <= 150 and all(r.accepted for r in verdicts), csv.csv_faults(found).collect()
    assert max(f.stat().st_size for f in (tmp_path / "out").rglob("*.csv")) <= 2000
    got = [(r.fields[0], r.fields[1]) for r in found.filter("row > 0").collect()]
    assert sorted(got, key=repr) == sorted(((None if a is None else str(a), c or None) for a, c in rows), key=repr)
    csv.write_csv(spark.createDataFrame([], "a long"), f"{tmp_path}/none", limits)
    assert csv.csv_records(spark, f"{tmp_path}/none", limits).count() == 0
    wide = spark.createDataFrame([("x" * 3000,), ("y",)], "a string")
    csv.write_csv(wide, f"{tmp_path}/wide", limits)
    assert sorted(r.rule for r in csv.csv_faults(csv.csv_records(spark, f"{tmp_path}/wide", limits)).collect()) == ["too_large"]


def large_part(spark, path):
    """More than four files of a contract's bytes hold."""
    part = spark.range(600).selectExpr("id AS p_partkey", "concat('name ', id, ' ', repeat('x', 90000)) AS p_name", "'b' AS p_brand", "'LARGE' AS p_type", "CAST(id % 50 AS INT) AS p_size", "1.5D AS p_retailprice")
    part.repartition(4).write.parquet(f"{path}/part.parquet")
    name = lambda i: f"name {i} " + "x" * 90000
    return {str(i): (f'say "{name(i)}",\nthen' if i % 5 == 0 else name(i), "b" if i % 7 else None, "LARGE", str(i % 50)) for i in range(600)}


def test_preview_of_a_table_beyond_four_files(spark, tmp_path):
    want = large_part(spark, tmp_path)
    got = {r.column: r for r in entry.queries()["csv_preview"](spark, str(tmp_path)).collect()}
    assert {c: r.type for c, r in got.items()} == {"p_partkey": "integer", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "integer"} and {r.row_count for r in got.values()} == {600}
    assert got["p_name"].sample == [want[str(i)][0] for i in range(3)] and got["p_brand"].sample == [None, "b", "b"]


def test_rows_of_a_table_beyond_four_files(spark, tmp_path):
    want = large_part(spark, tmp_path)
    got = entry.queries()["read_csv_strict"](spark, str(tmp_path)).collect()
    assert len(got) == 600 and {r[0]: tuple(r)[1:] for r in got} == want


def test_headers_that_differ_and_nothing_to_accept(spark, tmp_path):
    for named in ({"a": "x,y\n1,2\n", "b": "x,z\n1,2\n"}, {"a": "x,y\n1\n"}):
        with pytest.raises(ValueError):
            csv.read_csv_strict(spark, put(tmp_path / str(len(named)), **named))


def test_records_are_those_of_a_strict_parser():
    rng = random.Random(3)
    for _ in range(300):
        text = "a,b\n" + "".join(rng.choices(['"', ",", "\n", "x", "é", " ", "\r\n"], k=rng.randrange(25)))
        try:
            want = list(python_csv.reader(io.StringIO(text, newline=""), strict=True))[1:]
        except python_csv.Error:
            assert any(rule == "malformed" for _, rule, _, _ in csv.records(text.encode(), csv.Contract()))
            continue
        got = [f for row, rule, _, f in csv.records(text.encode(), csv.Contract()) if row > 0 and rule is None]
        assert got == [[x or None for x in r] for r in want if len(r) == 2]


def test_inventory_opens_files_for_their_first_bytes(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"nope"), ("c.pdf", b""), ("d.txt", b"%PDF-"), ("e.pdf", b"%PDF-" + b"x" * 99), ("deep/f f.PDF", b"%PDF-"), ("g.docx", b"PK\3\4..")):
        (folder / name).write_bytes(data)
    with open(folder / "big.pdf", "wb") as f:
        f.write(b"%PDF-")
        f.truncate(3 << 30)  # as a whole it would not fit into a row
    got = {r.path.rsplit("/", 1)[1].replace("%20", " "): r.status for r in files.file_inventory(spark, str(folder), "pdf", 4 << 30).collect()}
    assert got == {"a.pdf": "kept", "b.pdf": "magic", "d.txt": "extension", "e.pdf": "kept", "f f.PDF": "kept", "g.docx": "extension", "big.pdf": "kept"}
    assert {r.path.rsplit("/", 1)[1]: r.status for r in files.file_inventory(spark, str(folder), "docx", 50).collect()}["g.docx"] == "kept"
    small = {r.path.rsplit("/", 1)[1]: r.status for r in files.file_inventory(spark, str(folder), "pdf", 50).collect()}
    assert small["e.pdf"] == small["big.pdf"] == "too_large"
    assert {r.status for r in files.file_inventory(spark, str(folder), "txt").collect()} == {"kept", "extension"}


@pytest.mark.parametrize(
    "html, text, title, links",
    [
        ("<title>A &amp; B</title><p>x<b>y</b></p>", "A & B x y", "A & B", []),
        ("a<script>if (x < y) '<p>'</script>b<style>p>q</style>c", "a b c", None, []),
        ("a<nav>b<form>c</form>d</nav>e", "a e", None, []),
        ("a<nav>b<form>c</nav>d</form>e", "a", None, []),
        ("a</nav>b<svg/>c<svg>d</svg>e", "a b c e", None, []),
        ("a<!-- <nav> -->b<!-- open", "a b<!-- open", None, []),
        ("<a href='x>y' title=\"<b>\">t</a><a href=' '>u</a><nav><a href=z>v</a></nav>", "t u", None, ["x>y", "z"]),
        ("x < y <3 <a", "x < y <3 <a", None, []),
        ("<p title=\"open>text</p>more", "text more", None, []),
        ("a<script>never closed <p>b", "a", None, []),
        ("<nav-bar>kept</nav-bar><title>t", "kept t", "t", []),
    ],
)
def test_pages_by_hand(html, text, title, links):
    got = ingest.page_facts(html, None)
    assert (got["text"], got["title"], got["links"]) == (text, title, links)


@pytest.mark.parametrize("piece", ["<a ", "<script>", "<!--", "<nav>", '<a "', "<a '\">", '<a "x>" ', "<title>", "</nav>", "<a href=x>", "<"])
def test_pages_cost_time_in_proportion(piece):
    def seconds(n):
        html, began = piece * (n // len(piece)), time.process_time()
        ingest.page_facts(html, None)
        return time.process_time() - began

    seconds(1000)
    small = min(seconds(100_000) for _ in range(3))
    assert min(seconds(800_000) for _ in range(2)) < 8 * 4 * small + 0.05


def test_pages_without_text_take_no_number(spark):
    pages = spark.createDataFrame([("s", 1, 0, "one"), ("s", 2, 0, None), ("s", 2, 1, "  "), ("s", 3, 0, "three")], "source string, page long, position long, text string")
    assert sorted((r.page, r.chunk_index) for r in ingest.chunk_pages(pages).collect()) == [(1, 0), (3, 1)]


def test_ranks_are_exact(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1)) for _ in range(5001)] + [("b", float(rng.randrange(4))) for _ in range(2000)] + [("c", 7.5), (None, 1.0), (None, 2.0), ("a", None), ("d", None)]
    rows += [("e", 1e300 if i % 50 == 0 else 1e-300 * i) for i in range(999)]
    df = spark.createDataFrame(rows, "g string, latency double").repartition(5)
    want = df.groupBy("g").agg(F.median("latency").alias("m"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)").alias("p")).filter("m is not null").collect()
    for accuracy in (100_000, 50):
        places = {"low": (0.5, lambda n: F.floor((n + 1) / 2)), "p": (0.95, lambda n: F.ceil(n * 0.95 - 1e-9))}
        got = evaluation.order_statistics(df, ["g"], "latency", places, accuracy).collect()
        assert {r.g: r.p for r in got} == {r.g: r.p for r in want}
    got = evaluation.latencies(df, ["g"]).collect()
    assert {r.g: (r.median_latency, r.p95_latency) for r in got} == {r.g: (pytest.approx(r.m), r.p) for r in want}
    one = evaluation.latency_cost_summary(df.filter("g = 'a'"), "latency", "latency").first()
    assert one.median_latency == next(r.m for r in want if r.g == "a")
    assert evaluation.latency_cost_summary(df.limit(0), "latency", "latency").count() <= 1


def test_few_values_are_put_in_order(spark):
    """Between the sketch's bounds lie few values: the window sorts those, not the group's."""
    df = spark.range(200_000).selectExpr("1 AS g", "CAST(hash(id) AS DOUBLE) AS latency")
    places = {"p": (0.95, lambda n: F.ceil(n * 0.95))}
    found = evaluation.order_statistics(df, ["g"], "latency", places, 1000)
    assert found.first().p == df.selectExpr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)").first()[0]


def test_links_and_crawls_of_hosts(spark):
    pages = [("http://A.example/x?q=1#top", "<a href='/y'>1</a><a href='z#f'>2</a><a href='//b.example/'>3</a><a href='mailto:q@a.example'>4</a><a href='http://[bad'>5</a><a href='/y'>6</a>"), (None, "<a href='/q'>"), ("http://c.example", None), ("ftp://d.example/", "<a href='/q'>q</a>")]
    got = sorted(map(tuple, ingest.page_links(spark.createDataFrame(pages, "url string, html string")).collect()))
    assert got == [("http://a.example/x?q=1", "http://a.example/y"), ("http://a.example/x?q=1", "http://a.example/z")]
    rng = random.Random(4)
    name = lambda h, i: f"http://{h}.example/{i:03d}"
    links = {(name(h, rng.randrange(60)), name(h, rng.randrange(60))) for h in "abc" for _ in range(90)} | {(name("a", 0), name("a", i)) for i in range(40)}
    seeds = [name("a", 0), name("a", 5), name("b", 1), name("d", 9)]
    for limit, queue in ((10, 2), (30, 10), (1, 1)):
        want = []
        for h in "abd":
            line = sorted(s for s in seeds if f"/{h}." in s)[: limit * queue]
            depth, level = {u: 0 for u in line}, line
            while level:
                new = sorted({d for u in level if line.index(u) < limit for s, d in links if s == u} - set(line))[: limit * queue - len(line)]
                depth |= {u: depth[level[0]] + 1 for u in new}
                line, level = line + new, new
            want += [(f"{h}.example", u, depth[u], i + 1) for i, u in enumerate(line[:limit])]
        found = ingest.crawl_hosts(spark.createDataFrame(sorted(links), "src string, dst string"), spark.createDataFrame([(s,) for s in seeds], "url string"), limit, queue)
        assert sorted(map(tuple, found.collect())) == sorted(want)
