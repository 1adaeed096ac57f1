import inspect
import pathlib

import pytest

import corpus_pipeline
from tesserae.llm import common, quality

from . import cases
from .test_decontam import expected as contaminated
from .test_linedup import BLANK, key
from .test_linedup import expected as line_deduped
from .test_minhash import expected as grouped
from .test_mixing import water_fill


def strip(data):
    holders = {}
    for d, text in data:
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    return [(d, "\n".join(x for x in text.split("\n") if first.get(key(x), d) == d)) for d, text in data]


def test_against_brute_force(spark, tmp_path):
    """Every stage over a table, by the plain rules, on what the stage before kept."""
    folder = str(tmp_path)
    docs = cases.table(spark, "sf0.01", "documents").where("doc_id < 450")
    near = docs.where("doc_id % 40 = 3").selectExpr("doc_id + 2000 AS doc_id", "regexp_replace(text, '\\n', ' ') || ' end' AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(near).coalesce(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    cases.table(spark, "sf0.01", "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    rows = docs.collect()
    source = {r.doc_id: r.source for r in rows}
    m = quality.measure([(r.text or "").encode() for r in rows])
    kept = [(r.doc_id, r.text) for r, k in zip(rows, quality.verdict(m)[1], strict=True) if k]
    assert 0 < len(kept) < len(rows)
    stripped = strip(kept)
    assert [cases.sha(t) for _, t in stripped] == [x[3] for x in line_deduped(kept)]
    before = dict(kept)
    stripped = [(d, t) for d, t in stripped if t == before[d] or t.strip(BLANK)]
    assert len(stripped) < len(kept)
    firsts = [x[0] for x in grouped(stripped, n=5) if x[3]]
    unique = [x for x in stripped if x[0] in set(firsts)]
    assert len(unique) < len(stripped)
    items = [(r.item_id, r.text) for r in cases.table(spark, "sf0.01", "benchmark").collect()]
    bad = {x[0] for x in contaminated(unique, items) if x[5]}
    clean = {d: t for d, t in unique if d not in bad}
    assert bad
    result = corpus_pipeline.run(spark, folder)
    assert set(result.columns) == {*docs.columns, "copy", "words"}
    got = result.collect()
    assert {r.doc_id for r in got} <= {d for d, t in clean.items() if t.strip()}
    sizes, taken, whole = {}, {}, {}
    for d, t in clean.items():
        sizes[source[d]] = sizes.get(source[d], 0) + len(cases.WORD.findall(t))
    for r in got:
        n = len(cases.WORD.findall(r.text))
        assert n == r.words and r.source == source[r.doc_id]
        assert r.text == clean[r.doc_id] or clean[r.doc_id].split()[:n] == r.text.split()
        taken[r.source] = taken.get(r.source, 0) + n
        whole[r.doc_id] = whole.get(r.doc_id, 0) + 1
    for s, t in water_fill(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 1
    assert max(whole.values()) <= 3


def test_stages_keep_columns(spark):
    data = [r for r in cases.rows(2) if r[0] not in (1007,)]
    docs = cases.frame(spark, [*data, (None, "null id " * 60, None)])
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_scratch_tables_have_no_checksum_files_and_damage_is_found(spark):
    table = common.keep(spark.range(0, 5000, 1, 3), "plain")
    folder = pathlib.Path(table.inputFiles()[0].split(":", 1)[1].replace("///", "/")).parent
    assert table.count() == 5000 and not list(folder.glob(".*.crc"))  # each would be a process more that a task starts
    part = next(folder.glob("part-*"))
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 1
    part.write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum"):
        table.agg({"id": "sum"}).collect()
    common.forget(table)
