import bz2
import gzip
import io
import random
import tarfile
import zipfile

import pytest

from schemaloom.sources import archives


def contents(seed):
    rng = random.Random(seed)
    text = lambda n: bytes(rng.choice(b"abc \n\x00\xff") for _ in range(n))
    return {"a.txt": b"", "dir/b c.bin": text(5000), "dir/sub/é.txt": "ä\n".encode() * 700, "big.bin": text(300_000), "z": b"x"}


@pytest.fixture
def folder(tmp_path):
    want = {}
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        for i, (name, data) in enumerate(contents(1).items()):
            z.writestr(name, data, [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED][i % 2])
        z.mkdir("empty")
        want["one.zip"] = contents(1)
    (tmp_path / "deep").mkdir()
    for name, mode in (("two.tar", "w"), ("three.tar.gz", "w:gz"), ("four.tgz", "w:gz"), ("five.tar.bz2", "w:bz2")):
        with tarfile.open(tmp_path / "deep" / name, mode) as t:
            for n, data in contents(name).items():
                info = tarfile.TarInfo(n)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
            link = tarfile.TarInfo("link")
            link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
            t.addfile(link)
        want[name] = contents(name)
    data = contents(9)["big.bin"]
    (tmp_path / "f.txt.gz").write_bytes(gzip.compress(data) + gzip.compress(b"second stream"))
    (tmp_path / "g.txt.bz2").write_bytes(bz2.compress(data) + bz2.compress(b"more"))
    (tmp_path / "no.txt").write_text("no archive")
    want["f.txt.gz"], want["g.txt.bz2"] = {"f.txt": data + b"second stream"}, {"g.txt": data + b"more"}
    return tmp_path, want


@pytest.mark.parametrize("piece", [1000, archives.PIECE])
def test_members_of_all_kinds(spark, folder, piece):
    path, want = folder
    rows = archives.read_archives(spark, f"file://{path}", piece).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.archive, r.member, r.piece)):
        own = got.setdefault(r.archive.rsplit("/", 1)[1], {})
        own[r.member] = own.get(r.member, b"") + bytes(r.content)
        assert len(r.content) <= piece and (piece > 1000) <= (r.piece == 0)
    assert got == want


def test_unpacked_files(spark, folder, tmp_path_factory):
    path, want = folder
    target = tmp_path_factory.mktemp("out")
    done = archives.unpack(spark, f"file://{path}/one.zip", f"file://{target}").collect()
    assert {r.member: r.bytes for r in done} == {k: len(v) for k, v in want["one.zip"].items()}
    assert {str(p.relative_to(target)): p.read_bytes() for p in target.rglob("*") if p.is_file()} == want["one.zip"]
    archives.unpack(spark, f"file://{path}/deep")
    assert (path / "deep" / "dir" / "b c.bin").exists() and not (path / "deep" / "link").exists()


@pytest.mark.parametrize("name", ["../out.txt", "/abs.txt", "a/../../b", "c:\\x"])
def test_names_that_leave_the_folder_are_rejected_before_any_is_written(spark, tmp_path, name):
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("good.txt", "x")
        z.writestr(name, "x")
    with pytest.raises(ValueError, match="leave"):
        archives.unpack(spark, f"file://{tmp_path}")
    assert [p.name for p in tmp_path.iterdir()] == ["evil.zip"]
    with tarfile.open(tmp_path / "evil.tgz", "w:gz") as t:
        t.addfile(tarfile.TarInfo(name))
    (tmp_path / "evil.zip").unlink()
    with pytest.raises(Exception, match="leave"):
        archives.read_archives(spark, f"file://{tmp_path}").collect()


def test_damage_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a", b"0123456789" * 100)
    data = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(data.replace(b"0123456789", b"0123456780", 1))
    with pytest.raises(Exception, match="damaged"):
        archives.read_archives(spark, f"file://{tmp_path}").collect()
    (tmp_path / "a.zip").unlink()
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"x" * 9999)[:-20])
    with pytest.raises(Exception, match="too early"):
        archives.read_archives(spark, f"file://{tmp_path}").collect()


def test_written_archives(spark, tmp_path):
    rows = [("a", f"m{i}.txt", f"text {i}") for i in range(30)] + [("b", "é", None), ("c d", "x/y", "z" * 100_000)]
    done = archives.write_archives(spark.createDataFrame(rows, "a string, m string, c string"), f"file://{tmp_path}/z", "a", "m", "c").collect()
    assert {r.archive: r.members for r in done} == {"a": 30, "b": 1, "c d": 1}
    for a in ("a", "b", "c d"):
        with zipfile.ZipFile(tmp_path / "z" / f"{a}.zip") as z:
            assert {n: z.read(n) for n in z.namelist()} == {m: (c or "").encode() for x, m, c in rows if x == a}
    assert sorted(p.name for p in (tmp_path / "z").iterdir()) == ["a.zip", "b.zip", "c d.zip"]
