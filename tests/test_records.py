"""The delimited reader over ranges cut anywhere, against the standard library's reader."""

import csv
import io
import random

import numpy as np
import pytest

from leadmill.sources import delimited as dl
from leadmill.sources import records as rc


def plain(data, delimiter):
    """(row_number, first two cells) of the records behind the header."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    records = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]
    return [(i + 1, r) for i, r in enumerate(records) if i]


def files_of(pick):
    """Files of words, quotes, delimiters and breaks in any order."""
    out = {}
    for i in range(7):
        d = pick.choice([",", ";", "\t", "|"])
        bits = ["a", "b c", '"', '""', d, d, "\n", "\n", "\r\n", "\r", ",", ";", "é", f'"x{d}y"', '"p\nq"', '"p\r\nq"', f'\n"r""s{d}\n"t{d}', "中"]
        body = "".join(pick.choices(bits, k=pick.choice([0, 5, 40, 90])))
        if body.count('"') and len(plain((f"h\n{body}").encode(), d)) and pick.random() < 0.5:
            body += '"'
        head = pick.choice(["", "﻿"]) + f'name{d}"website"{d}city' + pick.choice(["\n", "\r\n"])
        # what follows an open quote to the end of a file is told apart from its last break by no line reader
        data = (head + body).rstrip("\r\n") + pick.choice(["", "\n"])
        latin = pick.random() < 0.3 and "中" not in data and "﻿" not in data
        out[f"f{i}.csv"] = (data.encode("latin-1" if latin else "utf-8"), d)
    return out


@pytest.fixture()
def narrow(spark):
    """Ranges of any given number of bytes."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before)


@pytest.mark.parametrize("seed, size", [(1, 40), (2, 1 << 27)])
def test_ranges_cut_anywhere_equal_the_library(spark, tmp_path, narrow, seed, size):
    files = files_of(random.Random(seed))
    for name, (data, _) in files.items():
        (tmp_path / name).write_bytes(data)
    narrow(size)
    stage = rc.staged(rc.text_lines(spark, str(tmp_path)))
    parts = rc.ranges(stage)
    assert size > 1000 or parts.count() > 8
    looks = dl.file_looks(parts)
    assert {r.file.rsplit("/", 1)[1]: r.delimiter for r in looks.collect()} == {n: d for n, (_, d) in files.items()}
    found = rc.cells_of_lines(stage, rc.starts(parts, looks.select("file", "encoding", "delimiter"))).collect()
    got = {n: [] for n in files}
    for r in sorted(found, key=lambda r: r.row_number):
        got[r.file.rsplit("/", 1)[1]].append((r.row_number, list(r.cells)))
    for name, (data, d) in files.items():
        want = plain(data, d)
        # the last cell of a file with an open quote may end in the file's last break
        if want and got[name] and want[-1] != got[name][-1]:
            assert want[-1][0] == got[name][-1][0] and [c.rstrip("\r\n") for c in want[-1][1]] == [c.rstrip("\r\n") for c in got[name][-1][1]]
            want, got[name] = want[:-1], got[name][:-1]
        assert got[name] == want, (name, data)


def test_one_file_in_many_tasks(spark, tmp_path, narrow):
    rows = [(f"Firm {i}", f'said "{i}",\nthen\r\n\nleft' if i % 3 else "é;", f"f{i}.com") for i in range(150)]
    with open(tmp_path / "one.csv", "w", newline="", encoding="latin-1") as f:
        csv.writer(f).writerows([("company", "industry", "url"), *rows])
    narrow(128)
    found, report = dl.read_leads(spark, str(tmp_path))
    assert {(r.row_number, r.name, r.industry, r.website) for r in found.collect()} == {(i + 2, *r) for i, r in enumerate(rows)}
    assert report.first().encoding == "ISO-8859-1"
    stage = rc.staged(rc.text_lines(spark, str(tmp_path)))
    counts = [r.n for r in stage.groupBy("block").count().selectExpr("count AS n").collect()]
    assert len(counts) > 30 and max(counts) < 60


def test_running_states_equal_a_loop():
    pick = np.random.default_rng(4)
    for _ in range(200):
        outside, inside = pick.integers(0, 2, (2, pick.integers(1, 30)))
        for start in (0, 1):
            state, want = start, []
            for a, b in zip(outside, inside):
                state = int(b if state else a)
                want.append(state)
            before, after = rc.running(outside, inside, start)
            assert after.tolist() == want and before.tolist() == [start, *want[:-1]]
