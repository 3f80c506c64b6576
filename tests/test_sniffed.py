"""Files of unknown packing, read piece by piece."""

import gzip
import io
import random

import pytest

from lumberline.sources import lines as source
from lumberline.sources.lines import scan_sniffed, unpacked_lines


class Counted(io.BytesIO):
    """A file that notes the largest piece asked for."""

    def __init__(self, content):
        super().__init__(content)
        self.largest = 0

    def read(self, size=-1):
        assert size > 0
        self.largest = max(self.largest, size)
        return super().read(size)


def made(seed):
    rng = random.Random(seed)
    return "\n".join("x" * rng.choice([0, 1, 5, 40, 3000]) + rng.choice(["", "ä", "\r", "日本"]) for _ in range(rng.randrange(1, 120)))


@pytest.mark.parametrize("step", [1, 2, 7, 64, 1 << 20])
def test_any_cut_gives_the_same_lines(step):
    for seed in range(12):
        text = made(seed)
        want = [x.removesuffix("\r") for x in text.split("\n")]
        if want[-1] == "" and not text.split("\n")[-1]:
            want = want[:-1]
        if text.split("\n")[-1].endswith("\r"):
            want[-1] += "\r"  # the last line has no end to belong to
        half = len(text) // 2
        members = gzip.compress(text[:half].encode()) + bytes(seed * 3) + gzip.compress(b"") + gzip.compress(text[half:].encode()) + bytes(5)
        for content in (text.encode(), gzip.compress(text.encode()), members):
            f = Counted(content)
            got = [x for part in unpacked_lines(f, step=step, rows=9) for x in part]
            assert got == want and f.largest == step


def test_what_unpacks_to_very_much_is_held_in_parts():
    text = b"".join(b"%09d\n" % i for i in range(2_000_000))  # 20 MB, and far less packed
    largest, seen = 0, 0
    for part in unpacked_lines(io.BytesIO(gzip.compress(b"0" * 30_000_000 + b"\n" + text, 9)), step=1 << 14, rows=5_000):
        largest, seen = max(largest, sum(map(len, part[1:]))), seen + len(part)
    assert seen == 2_000_001 and largest <= 5_000 * 10


def test_streams_that_stop_early():
    content = gzip.compress(b"one\ntwo\n" * 1000)
    for cut in (3, 12, len(content) // 2, len(content) - 1):
        with pytest.raises(EOFError):
            list(unpacked_lines(io.BytesIO(content[:cut]), step=5))
    assert list(unpacked_lines(b"")) == [] and list(unpacked_lines(b"a")) == [["a"]]


@pytest.mark.parametrize("piecewise", [None, True, False])
def test_files_with_and_without_their_contents_read_by_spark(spark, tmp_path, piecewise):
    folder = tmp_path / "with space%20and ü"
    folder.mkdir()
    want = []
    for i in range(5):
        text = f"{i} one\n{i} two\n"
        (folder / f"f{i}.bin").write_bytes(gzip.compress(text.encode()) if i % 2 else text.encode())
        want += text.split("\n")[:-1]
    df = scan_sniffed(spark, str(folder), piecewise)
    assert sorted(r.data for r in df.collect()) == sorted(want)
    read = df._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert ("content:binary" in read) == (piecewise is False)
    assert source.opened(df.first().file).read(1) in (b"0", b"\x1f")
