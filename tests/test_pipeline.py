"""Kernels by bands, records, archives, made-up captures and rebuilt highlights against plain loops."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry, text
from tessera.operators import bands, frames, recovery
from tessera.sources import archives, container, metadata, mock


def reflect(i, n):
    if n <= 1:
        return 0
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * n - 2 - i
    return i


def loops(raw, sev, forced, kernel, step, sigma, absolute, adaptive):
    out, n = raw.copy(), [0, 0, 0, 0, 0]
    h, w = raw.shape
    for y in range(h):
        for x in range(w):
            if sev[y, x] < 16 and sev[y, x] != 255:
                continue
            n[0] += 1
            ph, pw = -(-(h - y % step) // step), -(-(w - x % step) // step)
            r = kernel // 2
            near = sorted(int(raw[y % step + step * reflect(y // step + a, ph), x % step + step * reflect(x // step + b, pw)]) for a in range(-r, r + 1) for b in range(-r, r + 1))
            p = near[len(near) // 2]
            mad = sorted(abs(v - p) for v in near)[len(near) // 2]
            d = int(raw[y, x]) - p
            if forced[y, x] or not adaptive or (abs(d) if sev[y, x] == 255 else d) > max(sigma * max(mad, 1), absolute):
                out[y, x] = p
                n[1] += 1
                n[2] += d > 0
                n[3] += d < 0
                n[4] += bool(forced[y, x])
    return out, n


@pytest.mark.parametrize("kernel, mono, adaptive", [(3, True, True), (5, False, True), (7, False, False)])
def test_correction_like_loops(spark, kernel, mono, adaptive):
    draw = np.random.default_rng(kernel)
    raw, sev, forced = draw.integers(0, 1024, (139, 13)), draw.choice([0, 10, 16, 200, 255], (139, 13)), draw.random((139, 13)) < 0.05
    rows = spark.createDataFrame([(3, y, raw[y].tolist(), sev[y].tolist(), forced[y].astype(int).tolist()) for y in range(139)], "m int, y int, raw array<int>, sev array<int>, f array<int>")
    got = bands.corrected(rows, 139, kernel=kernel, mono=mono, adaptive=adaptive, sigma=1.5, absolute=9, forced="f").orderBy("y").collect()
    want, n = loops(raw, sev, forced, kernel, 1 if mono else 2, 1.5, 9, adaptive)
    assert [r.samples for r in got] == want.tolist()
    assert [sum(r[c] for r in got) for c in ("candidates", "corrected", "positive", "negative", "forced")] == n
    with pytest.raises(ValueError):
        bands.corrected(rows, 139, kernel=4)


def test_bands_meet_without_seams(spark):
    raw = np.random.default_rng(2).integers(0, 1024, (150, 10))
    rows = spark.createDataFrame([(0, y, raw[y].tolist()) for y in range(150)], "m int, y int, raw array<int>")
    got = bands.demosaiced(rows, 150, "GBRG").orderBy("y").collect()
    assert np.stack([[r.red, r.green, r.blue] for r in got]).transpose(0, 2, 1).tolist() == frames.simple(raw, "GBRG").tolist()


def rebuilt(raw, clip, black):
    """Plain loops over clipped sites of an RGGB frame."""
    h, w = raw.shape
    out, sure = raw.copy(), np.where(raw >= clip, 0, 255)
    colour = lambda y, x: (0 if y % 2 == 0 else 2) if y % 2 == x % 2 else 1

    def green(y, x):
        ways = []
        for a, b in (((0, -1), (0, 1)), ((-1, 0), (1, 0))):
            if not (0 < y < h - 1 and 0 < x < w - 1):
                return []
            u, v = float(raw[y + a[0], x + a[1]]), float(raw[y + b[0], x + b[1]])
            if u < clip and v < clip:
                ways.append(((u + v) / 2, abs(u - v)))
        return ways

    for y in range(2, h - 2):
        for x in range(2, w - 2):
            if raw[y, x] < clip:
                continue
            if colour(y, x) == 1:
                pairs = [(float(raw[y - a, x - b]), float(raw[y + a, x + b])) for a, b in ((0, 2), (2, 0), (2, 2), (-2, 2))]
                pairs = [p for p in pairs if max(p) < clip]
                if not pairs:
                    continue
                ws = [1 / (1 + abs(a - b) / 128) ** 2 for a, b in pairs]
                value, q = sum(k * (a + b) / 2 for k, (a, b) in zip(ws, pairs, strict=True)) / sum(ws), 148 + 20 * min(4, len(pairs))
            else:
                own = green(y, x)
                if not own:
                    continue
                g = min(own, key=lambda c: c[1])[0]
                ws, ds = [], []
                for a in (-2, 0, 2):
                    for b in (-2, 0, 2):
                        there = green(y + a, x + b)
                        if (a or b) and raw[y + a, x + b] < clip and there:
                            n = min(there, key=lambda c: c[1])[0]
                            ws.append(1 / (np.hypot(a, b) * (1 + abs(n - g) / 256)))
                            ds.append(raw[y + a, x + b] - n)
                if len(ws) < 2:
                    continue
                value, q = max(black, g + float(np.dot(ws, ds)) / sum(ws)), min(232, 128 + 20 * min(5, len(ws)) + 8 * len(own))
            out[y, x], sure[y, x] = min(65535, np.floor(max(value, clip) + 0.5)), q
    return out, sure


def test_highlights_like_loops(spark):
    raw = np.random.default_rng(5).integers(200, 1024, (80, 16))
    rows = spark.createDataFrame([(0, y, raw[y].tolist()) for y in range(80)], "m int, y int, raw array<int>")
    got = recovery.highlights(rows, 80, black=64.0, white=900.0).orderBy("y").collect()
    out, sure = rebuilt(raw, 64 + 836 * 0.995, 64.0)
    assert [r.sure for r in got] == sure.tolist()
    assert np.abs(np.array([r.samples for r in got]) - out).max() <= 1
    assert sum(r.clipped for r in got) == (raw >= 64 + 836 * 0.995).sum() and 0 < sum(r.recovered for r in got) < sum(r.clipped for r in got)


def test_islands():
    inverse = np.full((12, 12), np.nan)
    inverse[:5, :6] = 0.001
    inverse[8:10, 8:10] = 0.002
    inverse[6, 0:12] = np.linspace(0.003, 0.0031, 12)
    guide = np.zeros((12, 12))
    kept = recovery.islands(inverse, guide, 2e-5, least=10)
    assert kept.sum() == 30 + 12 and not kept[8:10, 8:10].any()
    guide[:, 3:] = 1.0  # an edge parts the patch
    assert recovery.islands(inverse, guide, 2e-5, least=14).sum() == 15 + 15


def test_records_and_profiles():
    draw = np.random.default_rng(1)
    maps = [draw.integers(0, 256, (4, 6)), draw.integers(0, 256, (3, 2))]
    data = archives.record_file(maps)
    assert [m.tolist() for m in archives.severity_maps(data)] == [m[::-1, ::-1].tolist() for m in maps]
    for broken in (data[:-1], b"x" + data[1:], data[:10], data[:40] + b"\0" * 4 + data[44:]):
        with pytest.raises((container.ContainerError, Exception)):
            list(archives.severity_maps(broken))
    profile = {"format": "f", "version": 1, "training_quantile": 0.5, "reference_exposure_ns": 5, "reference_analog_gain": 1.0, "reference_digital_gain": 1.0, "temperature_nodes_c": [20, 40], "families": {"color": [{"severity_min": 1, "severity_max_exclusive": 9, "excess_raw_codes": [1, 3]}], "mono": []}}
    assert archives.excess_nodes(json.dumps(profile), "f", 1) == [("color", 1, 9, 20.0, 1.0), ("color", 1, 9, 40.0, 3.0)]
    for wrong in ({"version": 2}, {"training_quantile": 1.0}, {"temperature_nodes_c": [20]}, {"reference_analog_gain": 0}):
        with pytest.raises(container.ContainerError):
            archives.excess_nodes(json.dumps(profile | wrong), "f", 1)


def test_ranged_reads_and_planes(spark, tmp_path):
    planes = {0: np.arange(96).reshape(6, 16), 9: np.full((6, 16), 77)}
    (tmp_path / "b.LRI").write_bytes(mock.capture(planes, reference=9, scene=4))
    (tmp_path / "a.lri").write_bytes(mock.capture({3: planes[0]}, reference=0))
    whole, sparse = container.blocks(spark, str(tmp_path)), container.sparse_blocks(spark, str(tmp_path))
    key = lambda df: [(r.path[-5:], r.block_index, r.start, r.length, r.kind, bytes(r.message)) for r in df.orderBy("path", "block_index").collect()]
    assert key(whole) == key(sparse) and len(key(whole)) == 4
    caps = {r.path[-5:]: r for r in metadata.captures(whole).collect()}
    assert caps["b.LRI"].reference == "B5" and caps["b.LRI"].night_mode and caps["b.LRI"].device == f"{9:016x}{7:016x}"
    files = container.files(spark, str(tmp_path))
    rows = metadata.plane_rows(files, metadata.raw_layout(metadata.modules(whole))).collect()
    got = {(r.path[-5:], r.camera, r.y): r.raw for r in rows}
    assert got["b.LRI", "A1", 2] == list(range(32, 48)) and got["b.LRI", "B5", 5] == [77] * 16 and len(got) == 18
    reads = {r.path[-5:]: (r.begin, r.end, r.what, r.wrong) for r in metadata.payload_reads(metadata.modules(sparse), metadata.captures(sparse)).collect()}
    assert reads == {"b.LRI": (152, 272, "payload", None)}  # the other's reference has no frame
    with pytest.raises(container.ContainerError):
        container.blocks(spark, str(tmp_path / "none")) if (tmp_path / "none").mkdir() is None else None


def test_bayer_jpeg_reads(spark):
    head = mock.nested(12, mock.module(2, 0, 64, 48, 32, form=metadata.BAYER_JPEG)) + mock.number(5, 2)
    lengths = (100, 200, 300, 70000)
    header = metadata.JPEG_MARK + b"\0" * 4 + b"".join(n.to_bytes(4, "little") for n in lengths)
    files = spark.createDataFrame([("x", bytearray(container.framed(0, head, header.ljust(80000, b"\0"))))], "path string, content binary")
    blocks = container.parsed(files)
    m, c = metadata.modules(blocks), metadata.captures(blocks)
    assert metadata.payload_reads(m, c).select("begin", "end", "what").collect() == [(32, 32 + 1576, "header")]
    known = spark.createDataFrame([("x", bytearray(header))], "path string, header binary")
    assert metadata.payload_reads(m, c, known).select("begin", "end", "what").collect() == [(32, 32 + 1576 + sum(lengths), "payload")]


def test_rays_meet_their_pixels(spark):
    camera = geometry.Camera(k=((50, 0.5, 32), (0, 48, 24)), turn=((0.8, 0, -0.6), (0, 1, 0), (0.6, 0, 0.8)), shift=(0, 0, 0), width=64, height=48, bend=(0.05, -0.01, 0.001, -0.002, 0.0), centre=(32, 24), scale=50)
    u, v = F.lit(40.0), F.lit(11.0)
    r = spark.range(1).select(*(c.alias(n) for c, n in zip(geometry.ray(camera, u, v), "xyz", strict=True)))
    back = r.select(*(c.alias(n) for c, n in zip(geometry.projected(camera, F.col("x") * 7, F.col("y") * 7, F.col("z") * 7), "uv", strict=True))).first()
    assert back.u == pytest.approx(40, abs=1e-9) and back.v == pytest.approx(11, abs=1e-9)
    behind = r.select(geometry.projected(camera, -F.col("x"), -F.col("y"), -F.col("z"))[0].alias("u")).first()
    assert behind.u is None


def test_draws_and_texts(spark):
    # The first draws of the congruence for ten points, by exact integers.
    state, want = 0x9E3779B97F4A7C15 ^ 10, []
    while len(want) < 4:
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        want += [(state >> 33) % 10] if (state >> 33) % 10 not in want else []
    assert next(frames.fours(10, 1)) == want and all(len(set(f)) == 4 for f in frames.fours(7, 50))
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(text.path_key(F.lit("/data/in/Día 1/L16_00.01.lri"), "/data/in")) == "D_a_1__L16_00.01" and one(text.path_key(F.lit("/x/.lri"), "/x")) == ".lri"
    assert [one(text.decimal_size(F.lit(n).cast("long"))) for n in (999, 1000, 123_400_000, 99_949)] == ["999 B", "1.0 KB", "123 MB", "99.9 KB"]
    assert one(text.moment(F.lit("2024-08-23 01:30:00").cast("timestamp"), F.lit(-330))) == "2024-08-23 01:30:00 -05:30"
    assert one(text.illuminant(F.lit(None).cast("int"))) == "MISSING" and one(text.illuminant(F.lit(99))) == "UNKNOWN"


def test_correction_leaves_absent_rows_out(spark):
    """A frame cut at a band's end, with rows missing within: what is left of a phase is sorted, and its place of 25 is the median."""
    draw = np.random.default_rng(8)
    raw, sev, forced = draw.integers(0, 1024, (128, 13)), draw.choice([10, 16, 255], (128, 13)), draw.random((128, 13)) < 0.3
    there = [y for y in range(64) if y not in (7, 8, 62) and not 20 <= y <= 40 or y == 30]
    rows = spark.createDataFrame([(3, y, raw[y].tolist() if y != 50 else None, sev[y].tolist(), forced[y].astype(int).tolist()) for y in there], "m int, y int, raw array<int>, sev array<int>, f array<int>")
    got = {r.y: r for r in bands.corrected(rows, 128, sigma=1.5, absolute=9, forced="f").collect()}
    there.remove(50)
    assert sorted(got) == there
    lost = 0
    for y in there:
        want, preds = raw[y].tolist(), []
        for x in np.flatnonzero(sev[y] >= 16).tolist():
            near = [(y % 2 + 2 * reflect(y // 2 + a, 64), x % 2 + 2 * reflect(x // 2 + b, -(-(13 - x % 2) // 2))) for a in range(-2, 3) for b in range(-2, 3)]
            near = sorted(int(raw[p]) for p in near if p[0] in there)
            pred = near[12] if len(near) > 12 else None
            if pred is not None:
                preds.append(pred)
                d = want[x] - pred
                gone = (abs(d) if sev[y, x] == 255 else d) > max(1.5 * max(sorted(abs(v - pred) for v in near)[12], 1), 9)
            if forced[y, x] or pred is not None and gone:
                want[x] = pred
        lost += want.count(None)
        assert (got[y].samples, got[y].sum_pred) == (want, sum(preds) if preds else None)
    assert lost


def test_highlights_of_a_cut_frame(spark):
    raw = np.random.default_rng(6).integers(200, 1024, (100, 16))
    rows = spark.createDataFrame([(0, y, raw[y].tolist()) for y in range(56)], "m int, y int, raw array<int>")
    got = recovery.highlights(rows, 100, black=64.0, white=900.0).orderBy("y").collect()
    raw[56:] = 1 << 30  # absent: never good
    out, sure = rebuilt(raw, 64 + 836 * 0.995, 64.0)
    assert [r.sure for r in got] == sure[:56].tolist()
    assert np.abs(np.array([r.samples for r in got]) - out[:56]).max() <= 1
