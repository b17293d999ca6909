"""The manifest source against whole-file reads, with ranges of every size, pruned splits and digests."""

import hashlib
import json

import pytest

from talkweft.sources import manifest as S


def corpus(folder, files, **extra):
    entries = {}
    for name, data in files.items():
        if data is not None:
            (folder / f"{name}.jsonl").write_bytes(data)
        entries[name] = {"path": f"{name}.jsonl", "sha256": hashlib.sha256(data or b"").hexdigest()} | extra.get(name, {})
    (folder / "manifest.json").write_text(json.dumps({"splits": entries}))
    return str(folder / "manifest.json")


def plain(data):
    out, at = [], 0
    for line in data.split(b"\n"):
        out.append((at, line.removesuffix(b"\r")))
        at += len(line) + 1
    return out[:-1] if not out[-1][1] else out


@pytest.mark.parametrize("data", [b"", b"one", b"one\n", b"\n\n\n", b"a\r\nbb\n\nccc", b"x" * 500 + b"\n" + b"y\n" * 40, "é漢\n😀\n".encode()])
def test_every_range_size(tmp_path, data):
    (tmp_path / "f").write_bytes(data)
    for step in (1, 2, 3, 7, 64, 10_000):
        got = [x for a in range(0, max(1, len(data)), step) for x in S.lines_of(str(tmp_path / "f"), a, min(a + step, len(data)))]
        assert got == plain(data), step


def test_reads_all_splits(spark, tmp_path):
    files = {"train": b"\xef\xbb\xbf{\"a\": 1}\n" + b"{\"b\": 2}\n" * 5000, "test": b"{}\n"}
    path = corpus(tmp_path, files)
    df = S.read_manifest_lines(spark, path, range_bytes=4096)
    assert df.rdd.getNumPartitions() > 10
    got = sorted((r.split, r.offset, r.value) for r in df.collect())
    assert got == sorted((s, o, v.decode("utf-8-sig" if o == 0 else "utf-8")) for s, d in files.items() for o, v in plain(d))


def test_pruned_splits_are_not_opened(spark, tmp_path):
    """The files of the other splits aren't even there."""
    path = corpus(tmp_path, {"train": b"1\n2\n", "validation": None, "test": None, "out": b"3\n"}, out={"included": False})
    df = S.read_manifest_lines(spark, path, ["train"])
    assert df.rdd.getNumPartitions() == 1 and sorted(r.value for r in df.collect()) == ["1", "2"]
    with pytest.raises(Exception, match="validation"):
        S.read_manifest_lines(spark, path).count()
    assert S.read_manifest_lines(spark, path, ["none"]).count() == 0


def test_digests(spark, tmp_path):
    path = corpus(tmp_path, {"train": b"1\n2\n" * 9, "test": b"4\n"}, test={"sha256": "0" * 64})
    assert S.read_manifest_lines(spark, path, ["train"], verify="true", range_bytes=5).count() == 18
    assert S.read_manifest_lines(spark, path).count() == 19
    with pytest.raises(Exception, match="digest of .*test.jsonl differs"):
        S.read_manifest_lines(spark, path, verify="true").count()


def test_paths_stay_inside(spark, tmp_path):
    for bad in ("/etc/passwd", "../x", "a/../../x"):
        (tmp_path / "manifest.json").write_text(json.dumps({"tool_sft": [{"name": "train", "path": bad}]}))
        with pytest.raises(Exception, match="manifest-relative"):
            S.read_manifest_lines(spark, str(tmp_path / "manifest.json")).count()
