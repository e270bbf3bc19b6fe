import hashlib
import random
import zlib

import pytest

from examweft.llm import media as M


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1025, 8192, 8193, 9216, 131_072, 131_073, 400_000])
def test_round_trip(n):
    payload = M.text_payload(random.Random(n).randbytes(n))
    assert len(payload) % 64 == 0 and payload
    data = M.write(payload)
    stream = M.parse(data)
    assert stream.doc_type == "matroska" and M.track_payload(data, stream) == payload and stream.tracks[0]["codec"] == "A_PCM/INT/LIT"
    for time, track, at in stream.cues:
        assert track == 1 and data[at : at + 4] == M.CLUSTER.to_bytes(4, "big")
    assert sum(p.size for p in stream.packets) == len(payload) and len(stream.cues) == len(stream.clusters)


def frames(*sizes):
    return [bytes([i]) * n for i, n in enumerate(sizes)]


@pytest.mark.parametrize(("kind", "sizes"), [(M.NO_LACE, (7,)), (M.XIPH, (255, 254, 510, 0, 3)), (M.FIXED, (9, 9, 9)), (M.EBML_LACE, (500, 20_000, 3, 3, 64)), (M.EBML_LACE, (1, 1)), (M.XIPH, (1, 2))])
@pytest.mark.parametrize("group", [False, True])
@pytest.mark.parametrize("unknown", [False, True])
def test_lacing_groups_and_unknown_sizes(kind, sizes, group, unknown):
    fs = frames(*sizes)
    block = M.block(2, -3, kind, fs)
    body = M.uint(M.TIMESTAMP, 1000) + (M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block) + M.uint(M.BLOCK_DURATION, 5) + M.uint(M.REFERENCE, 1)) if group else M.element(M.SIMPLE_BLOCK, block))
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body if unknown else M.element(M.CLUSTER, body)
    segment = M.element(M.INFO, M.uint(M.TIMESTAMP_SCALE, 500)) + cluster + M.element(M.CLUSTER, M.uint(M.TIMESTAMP, 9))
    data = M.element(M.EBML, M.element(M.DOC_TYPE, b"webm")) + (M.SEGMENT.to_bytes(4, "big") + b"\xff" + segment if unknown else M.element(M.SEGMENT, segment))
    s = M.parse(data)
    assert [data[p.offset : p.offset + p.size] for p in s.packets] == fs and len(s.clusters) == 2
    assert {(p.track, p.timestamp, p.lacing, p.keyframe) for p in s.packets} == {(2, 997, kind, not group)} and s.scale == 500


def test_numbers():
    for n in (0, 1, 126, 127, 128, 16_382, 16_383, 2**32, 2**56 - 2):
        assert M.get_number(M.put_size(n), 0)[0] == n
    with pytest.raises(ValueError):
        M.parse(b"not matroska")
    with pytest.raises(ValueError):
        M.parse(M.write(b"x" * 64)[:-30] + b"\x00")


def test_columns(spark, odd, none):
    files = M.encode(odd)
    rows = M.describe(files).collect()
    texts = {(r.doc_id, r.text or "") for r in odd.collect()}
    assert len(rows) == odd.count()
    seen = set()
    for r in rows:
        t = next(t for i, t in texts if i == r.doc_id and len(t.encode()) == r.n_bytes)
        payload = M.text_payload(t.encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        seen.add((t, r.media_sha256, r.feature))
    assert len(seen) == len({t for t, _, _ in seen})
    table = M.packets(files).where("doc_id = 6").orderBy("packet").collect()
    assert sum(r["size"] for r in table) == 70_016 and table[-1].timestamp_ns > 0 and table[0].error is None
    broken = spark.createDataFrame([(1, b"oops"), (2, None)], "doc_id long, media binary")
    assert [(r.doc_id, r.error is not None) for r in M.packets(broken).collect()] == [(1, True)]
    assert M.describe(M.encode(none)).count() == 0 and M.packets(M.encode(none)).count() == 0
