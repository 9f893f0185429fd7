"""Frames, footers, heads and tails of self-made files; record codecs; TAR members."""

import tarfile
from io import BytesIO

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.functions import codecs
from ledgerline.sources import container as c

LAYOUT = c.Layout()


def skippable(magic, payload):
    return magic.to_bytes(4, "little") + len(payload).to_bytes(4, "little") + payload


def archive(commits=2):
    out = skippable(0x184D2A57, b"descriptor")
    for seq in range(commits):
        out += codecs.zstd_encode(b"content %d " % seq * 1000)
        commit = skippable(0x184D2A51, b"record %d" % seq)
        out += commit
        out += c.write_footer(commit, len(out) - len(commit), seq, LAYOUT)
    return out


def test_frames_are_walked_to_their_end():
    data = archive()
    kinds = [(f.kind, f.offset) for f, fault, _ in c.frames(data, LAYOUT) if fault is None]
    assert [k for k, _ in kinds] == ["descriptor", "data", "commit", "footer", "data", "commit", "footer"]
    big = codecs.zstd_encode(bytes(range(256)) * 4000)
    assert c.walk(big, 0, LAYOUT).size == len(big)
    for cut in range(len(big) - 12, len(big)):
        with pytest.raises(c.Broken, match="truncated"):
            c.walk(big[:cut], 0, LAYOUT)
    assert [fault for _, fault, _ in c.frames(data + b"junk", LAYOUT)][-1] == "not_a_frame"
    assert [fault for _, fault, _ in c.frames(data + skippable(0x184D2A57, b""), LAYOUT)][-1] == "misplaced"


def test_heads_and_tails(spark, tmp_path):
    data = archive(3)
    torn = codecs.zstd_encode(b"x" * 500)
    broken = bytearray(data)
    broken[-1] ^= 1
    files = {
        "whole": (data, (2, "eof", "clean", None)),
        "tail": (data + torn, (2, "scan", "uncommitted", None)),
        "torn": (data + torn[:-3], (2, "scan", "uncommitted", None)),
        "zeros": (data + bytes(100), (2, "scan", "unresolved", "not_a_frame")),
        "damaged": (bytes(broken), (1, "scan", "unresolved", "footer_header")),
        "descriptor": (data + skippable(0x184D2A57, b"x" * 80), (2, "scan", "unresolved", "descriptor_frame")),
    }
    assert c.locate(b"", LAYOUT) == (None, "scan") and c.tail_state(b"", 0, LAYOUT) == ("clean", None)  # Spark lists no empty files
    for name, (raw, _) in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: (r.seq, r.source, r.tail, r.reason) for r in c.scan_heads(spark, str(tmp_path)).collect()}
    assert got == {name: want for name, (_, want) in files.items()}
    rows = c.scan_frames(spark, str(tmp_path)).where("path like '%/whole'").orderBy("offset").collect()
    assert [r.offset for r in rows] == [sum(x.size for x in rows[:k]) for k in range(len(rows))] and rows[1].content_size == 10_000


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(1 << 64), (1 << 64) - 1) | st.binary(max_size=40) | st.text(max_size=20),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.integers(0, 1 << 40), x, max_size=4),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(VALUES)
def test_cbor_round_trip(value):
    assert codecs.cbor_decode(codecs.cbor_encode(value)) == value


def test_cbor_faults():
    cases = {"1801": "not_shortest", "190017": "not_shortest", "5f": "indefinite", "1c": "reserved", "c0": "tag", "f90000": "float", "f7": "simple_value", "a1617800": "key_not_unsigned", "a202000100": "key_order", "a201000100": "key_order", "62c328": "not_utf8", "5903e8": "length_exceeds_input", "1a": "truncated", "0000": "trailing_bytes"}
    for raw, fault in cases.items():
        with pytest.raises(codecs.Fault, match=fault):
            codecs.cbor_decode(bytes.fromhex(raw))
    with pytest.raises(codecs.Fault, match="too_deep"):
        codecs.cbor_decode(b"\x81" * 80 + b"\x00")


def test_zstd_never_makes_more_than_promised():
    data = b"abc" * 1000
    assert codecs.zstd_decode(codecs.zstd_encode(data), 3000) == data
    for raw, n, fault in ((codecs.zstd_encode(data), 2999, "length_mismatch"), (codecs.zstd_encode(data), 3001, "length_mismatch"), (b"nonsense", 3, "malformed"), (codecs.zstd_encode(data), 1 << 32, "limit_exceeded")):
        with pytest.raises(codecs.Fault, match=fault):
            codecs.zstd_decode(raw, n)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 0xFFFF), max_size=12))
def test_names_round_trip(units):
    raw = b"".join(u.to_bytes(2, "little") for u in units)
    assert codecs.utf16_of_wtf8(codecs.wtf8_of_utf16(raw)) == raw


def test_names_that_are_refused(spark):
    for bad in (b"\xff", b"\xed\xa0\x80\xed\xb0\x80"):
        with pytest.raises(codecs.Fault):
            codecs.utf16_of_wtf8(bad)
    assert codecs.case_key(b"A\xff\xc3\x89") == b"a\xff\xc3\xa9"
    frame = spark.createDataFrame([(bytearray(b"A\xff"),), (None,)], "name binary")
    assert [r[0] for r in frame.select(codecs.column(codecs.case_key, "binary")("name")).collect()] == [bytearray(b"a\xff"), None]


MEMBERS = [
    codecs.Member(b"docs", True, mode=0o755),
    codecs.Member(b"docs/a.txt", size=5, secs=1_700_000_000),
    codecs.Member(b"d" * 120 + b"/\xff", size=3, uid=1 << 22, secs=5, nanos=120_000_000),
    codecs.Member("é/".encode() * 60 + b"x", secs=-3, nanos=250_000_000),
    codecs.Member(b"empty"),
]


def test_tar_members_round_trip():
    contents = [b"x" * m.size for m in MEMBERS]
    data = codecs.tar_stream(list(zip(MEMBERS, contents, strict=True)))
    assert list(codecs.tar_members(data)) == list(zip(MEMBERS, contents, strict=True))
    plain = codecs.tar_stream([(MEMBERS[0], b""), (MEMBERS[1], b"hello")])
    with tarfile.open(fileobj=BytesIO(plain)) as tar:
        assert [(m.name, m.size, m.mtime, m.mode) for m in tar] == [("docs", 0, 0, 0o755), ("docs/a.txt", 5, 1_700_000_000, 0o644)]
        assert tar.extractfile("docs/a.txt").read() == b"hello"
    for k in (0, 120, 150, 156, 600, 1600, len(plain) - 1):
        broken = bytearray(plain)
        broken[k] ^= 1
        with pytest.raises(codecs.Fault):
            list(codecs.tar_members(bytes(broken)))
    with pytest.raises(codecs.Fault, match="bad_end"):
        list(codecs.tar_members(plain + b"\0"))
