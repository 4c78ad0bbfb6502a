"""SQL for DuckDB that states the same results apart from the plans: named steps, joined with what they need."""

from __future__ import annotations

from dustline import profile as P


def dbl(v: float) -> str:
    return f"'{v!r}'::DOUBLE"


THR = dbl(P.IR_THRESHOLD)
FLOOR = f"({dbl(P.SCORE_FLOOR)}::FLOAT)"
PLANES = ("score", "sa", "sr", "sg", "sb")


def resp(c: str) -> str:
    return f"(65535.0::DOUBLE * log2(({c} + 1)::DOUBLE) / 16.0::DOUBLE)::FLOAT"


INV = dbl(__import__("math").log10(2.0) * 16.0 / 65535.0)


def inverse(i: str) -> str:
    h = f"floor(16.0::DOUBLE * pow(10.0::DOUBLE, 256.0::DOUBLE * (({i}) >> 8)::DOUBLE * {INV}) + 0.5::DOUBLE)::BIGINT"
    low = f"floor(65536.0::DOUBLE * pow(10.0::DOUBLE, (({i}) & 255)::DOUBLE * {INV}) + 0.5::DOUBLE)::BIGINT"
    return f"((({h} * {low}) >> 20) - 1)::INT"


def index(v: str) -> str:
    return f"trunc(least(greatest(({v})::DOUBLE + 0.5::DOUBLE, 0.0::DOUBLE), 65535.0::DOUBLE))::INT"


def fold(v: str, order: str) -> str:
    return f"list_reduce(list({v} ORDER BY {order}), lambda a, b: a + b)"


def lag(c: str, k: int, by: str) -> str:
    if k == 0:
        return c
    return f"{'lead' if k > 0 else 'lag'}({c}, {abs(k)}, 0.0::FLOAT) OVER {by}"


def total(parts: list[str]) -> str:
    return " + ".join(f"({p})::DOUBLE" for p in parts)


def _vertical() -> str:
    cols = []
    for p in PLANES:
        for n in (3, 5, 7, 9):
            cols.append(f"({total([lag(p, k, 'c') for k in (-1, 0, 1, -2, 2, -3, 3, -4, 4)[:n]])})::FLOAT AS {p}_{n}")
        cols.append(f"(({total([lag(p, -1, 'c'), p, lag(p, 1, 'c'), p])}) * 0.0625::DOUBLE)::FLOAT AS {p}_b")
        if p[1] in "rgb":
            cols += [f"{lag(p, -1, 'c')} AS {p}_u", f"{lag(p, 1, 'c')} AS {p}_d"]
    return f"SELECT *, {', '.join(cols)} FROM pad WINDOW c AS (PARTITION BY x ORDER BY y)"


def _averages() -> str:
    cols = []
    for p in PLANES:
        at = lambda n, k: lag(f"{p}_{n}", k, "r")  # noqa: B023, E731
        cols.append(f"({total([at(5, 4), at(5, -4), at(7, -3), at(7, 3), *[at(9, k) for k in range(-2, 3)]])}) * {dbl(P.Q69)} AS {p}_q69")
        cols.append(f"({total([at(3, 2), at(3, -2), at(5, -1), at(5, 0), at(5, 1)])}) * {dbl(P.Q21)} AS {p}_q21")
        if p[1] in "rgb":
            h = ["(" + total([lag(c, -1, "r"), lag(c, 1, "r"), c, c]) + ")" for c in (f"{p}_u", p, f"{p}_d")]
            cols.append(f"({h[0]} + {h[1]} + {h[1]} + {h[2]}) * 0.0625::DOUBLE AS {p}_q16")
        else:
            cols.append(f"{total([at('b', 0), at('b', -1), at('b', 1), at('b', 0)])} AS {p}_q16")
    return f"SELECT *, {', '.join(cols)} FROM vertical WINDOW r AS (PARTITION BY y ORDER BY x)"


def _features() -> str:
    cols = [f"score_q{n}::FLOAT AS W{n}, (CASE WHEN score_q{n} > 0 THEN sa_q{n} / score_q{n} ELSE 0 END)::FLOAT AS A{n}" for n in (69, 21, 16)]
    return f"SELECT *, {', '.join(cols)}, score AS W1, (CASE WHEN score > 0 THEN aux ELSE 0 END)::FLOAT AS A1 FROM averages"


def _ranges() -> str:
    cols = []
    for band, (a, b) in enumerate((("A69", "A21"), ("A21", "A16"), ("A16", "A1"))):
        steps = [f"({lag(b, k, by)})::DOUBLE - ({lag(a, k, by)})::DOUBLE" for k, by in ((0, "r"), (-1, "r"), (1, "r"), (-1, "c"), (1, "c"))]
        cols += [f"least({', '.join(steps)})::FLOAT AS lo{band}", f"greatest({', '.join(steps)})::FLOAT AS hi{band}"]
    return f"SELECT *, {', '.join(cols)} FROM features WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)"


def _candidates() -> str:
    cols = [f"(CASE WHEN W{n} > 0 THEN s{c}_q{n} * (1.0::DOUBLE / W{n}::DOUBLE) ELSE s{c}_q{n} END)::FLOAT AS C{n}{c}" for c in "rgb" for n in (69, 21, 16)]
    return f"SELECT *, {', '.join(cols)} FROM ranges WHERE NOT pad"


def zone(v: str, lo: str, hi: str, a: float, b: float) -> str:
    up = f"(CASE WHEN {lo} < 0 AND {hi} < 0 THEN {dbl(b)} * {hi} ELSE {dbl(a)} * {hi} END)"
    low = f"(CASE WHEN {lo} < 0 AND {hi} < 0 THEN {dbl(a)} * {lo} ELSE {dbl(b)} * {lo} END)"
    return f"(CASE WHEN {v} > {up} THEN {v} - {up} WHEN {v} < {low} THEN {v} - {low} ELSE 0.0::DOUBLE END)"


def _combined() -> str:
    cols = []
    for i, c in enumerate("rgb"):
        v = f"c.C69{c}::DOUBLE + {dbl(P.COARSE_SLOPES[i])} * (e.base_write::DOUBLE - c.A69::DOUBLE)"
        g = ("greatest(0.0::DOUBLE, least(1.0::DOUBLE, (c.W21::DOUBLE * 2.0::DOUBLE)::FLOAT::DOUBLE))", "greatest(c.W16::DOUBLE, 0.0::DOUBLE)", "(c.W1::DOUBLE * c.W1::DOUBLE)")
        for band, (coarse, fine) in enumerate(((f"c.C69{c}", f"c.C21{c}"), (f"c.C21{c}", f"c.C16{c}"), (f"c.C16{c}", f"e.w{c}"))):
            step = f"({dbl(P.BAND_SCALES[band])} * ({fine}::DOUBLE - {coarse}::DOUBLE))"
            v += f" + {g[band]} * {zone(step, f'c.lo{band}::DOUBLE', f'c.hi{band}::DOUBLE', P.FACTORS_A[band][i], P.FACTORS_B[band][i])}"
        cols.append(f"{v} AS k{c}")
    return f"SELECT e.y, e.x, {', '.join(cols)} FROM candidates c JOIN eligible e USING (y, x) WHERE e.eligible"


STEPS: dict[str, tuple[str, str]] = {
    "ev": ("", "SELECT event_id // 100 AS y, event_id % 100 AS x, (event_id // 100) % 50 AS ym, floor(value * 100 + 0.5::DOUBLE)::BIGINT AS c FROM events"),
    "px": (
        "ev",
        """SELECT 'main' AS frame_id, y::INT AS y, x::INT AS x, (30000 + (53 * y + 97 * x) % 3000 + c % 400)::INT AS r, (32000 + (67 * y + 71 * x) % 3000 + c % 400)::INT AS g,
        (34000 + (89 * y + 43 * x) % 3000 + c % 400)::INT AS b,
        (CASE WHEN ym = 9 AND x BETWEEN 60 AND 84 THEN 43000 + c % 4000 WHEN ym BETWEEN 14 AND 16 AND x BETWEEN 40 AND 42 THEN 900
         WHEN ym BETWEEN 2 AND 7 AND x >= 96 THEN 700 WHEN ym BETWEEN 5 AND 7 AND x BETWEEN 10 AND 12 THEN 900
         WHEN ym BETWEEN 20 AND 45 AND x BETWEEN 30 AND 55 THEN 500 + c % 300 ELSE 50000 + (31 * y + 29 * x) % 600 + c % 1500 END)::INT AS ir FROM ev""",
    ),
    "dims": ("px", "SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px"),
    "work": ("px", f"SELECT *, {resp('r')} AS wr, {resp('g')} AS wg, {resp('b')} AS wb, {resp('ir')} AS wi FROM px"),
    "latch": (
        "work dims",
        f"""SELECT y, x, ir, wr, wi, y // 8 AS band, x // 8 AS cell, x < 8 * (w // 8) AS active,
        x < 8 * (w // 8) AND max((ir <= {THR})::INT) OVER (PARTITION BY y // 8, x // 8 ORDER BY y, x ROWS UNBOUNDED PRECEDING) = 0 AS accepted FROM work, dims""",
    ),
    "sums": (
        "latch",
        f"""SELECT y, {fold('CASE WHEN accepted THEN ir::DOUBLE * ir::DOUBLE * wr::DOUBLE ELSE 0.0::DOUBLE END', 'x')} AS visible,
        {fold('CASE WHEN accepted THEN ir::DOUBLE * ir::DOUBLE * wi::DOUBLE ELSE 0.0::DOUBLE END', 'x')} AS infrared,
        {fold('CASE WHEN accepted THEN ir::DOUBLE * ir::DOUBLE ELSE 0.0::DOUBLE END', 'x')} AS weight, sum(accepted::INT)::INT AS n_accepted FROM latch GROUP BY y""",
    ),
    "cum": ("sums", "SELECT y, visible AS tv, infrared AS ti, weight AS tw FROM sums WHERE y = 0 UNION ALL SELECT s.y, c.tv + s.visible, c.ti + s.infrared, c.tw + s.weight FROM cum c JOIN sums s ON s.y = c.y + 1"),
    "means": (
        "cum sums",
        f"""SELECT y, n_accepted, tv, ti, tw, (CASE WHEN tw <> 0 THEN tv / tw ELSE {dbl(P.INITIAL_VISIBLE_MEAN)} END)::FLOAT AS mv, (CASE WHEN tw <> 0 THEN ti / tw ELSE {dbl(P.INITIAL_INFRARED_MEAN)} END)::FLOAT AS mi FROM cum JOIN sums USING (y)""",
    ),
    "quads": (
        "latch",
        f"""SELECT band, cell, q, (mv - av)::FLOAT AS dv, (mi - ai)::FLOAT AS di, raw FROM (
        SELECT *, ((sum(mv::DOUBLE) OVER w) * 0.25::DOUBLE)::FLOAT AS av, ((sum(mi::DOUBLE) OVER w) * 0.25::DOUBLE)::FLOAT AS ai, (sum(s) OVER w)::BIGINT AS raw FROM (
        SELECT band, cell, 2 * ((y % 8) // 4) + (x % 8) // 4 AS q, (sum(wr::DOUBLE) * 0.0625::DOUBLE)::FLOAT AS mv, (sum(wi::DOUBLE) * 0.0625::DOUBLE)::FLOAT AS mi, sum(ir) AS s
        FROM latch WHERE active AND (band, cell) IN (SELECT (band, cell) FROM latch GROUP BY band, cell HAVING count(*) = 64 AND min(ir) > {THR}) GROUP BY ALL) WINDOW w AS (PARTITION BY band, cell))""",
    ),
    "terms": (
        "quads",
        f"""SELECT *, wt * wt * raw::DOUBLE * raw::DOUBLE AS term FROM (SELECT *, CASE WHEN v = 0 OR ratio < {dbl(P.SCALE_RATIO_LOW)} OR ratio > {dbl(P.SCALE_RATIO_HIGH)} THEN 0.0::DOUBLE
        WHEN ratio < 0 OR ratio > {dbl(P.SCALE_RATIO_FULL_HIGH)} THEN v * {dbl(P.SCALE_OUTER_WEIGHT)} ELSE v END AS wt
        FROM (SELECT *, dv::DOUBLE AS v, CASE WHEN dv = 0 THEN 0.0::DOUBLE ELSE di::DOUBLE / dv::DOUBLE END AS ratio FROM quads))""",
    ),
    "epochs": ("terms", f"SELECT band, {fold('term', 'cell, q')}::FLOAT AS add_den, {fold('ratio * term', 'cell, q')}::FLOAT AS add_num FROM terms GROUP BY band"),
    "adds": ("epochs dims", "SELECT b AS band, coalesce(add_den, 0)::FLOAT AS ad, coalesce(add_num, 0)::FLOAT AS an FROM (SELECT unnest(range(0, h // 8)) AS b FROM dims) LEFT JOIN epochs ON band = b"),
    "states": (
        "adds",
        f"""SELECT 0 AS done, 0::FLOAT AS den, 0::FLOAT AS num, {dbl(P.INITIAL_SCALE)}::FLOAT AS p1, {dbl(P.INITIAL_SCALE)}::FLOAT AS p2 UNION ALL
        SELECT done + 1, (den::DOUBLE + ad::DOUBLE)::FLOAT, (num::DOUBLE + an::DOUBLE)::FLOAT,
        CASE WHEN den::DOUBLE + ad::DOUBLE <> 0 THEN (1.5::DOUBLE * ((num::DOUBLE + an::DOUBLE) / (den::DOUBLE + ad::DOUBLE)))::FLOAT ELSE p1 END,
        CASE WHEN den::DOUBLE + ad::DOUBLE <> 0 THEN ((num::DOUBLE + an::DOUBLE) / (den::DOUBLE + ad::DOUBLE))::FLOAT ELSE p2 END FROM states JOIN adds ON band = done""",
    ),
    "setter": (
        "means states",
        f"""SELECT *, ((mi::DOUBLE - mv::DOUBLE * q2::DOUBLE) / (1.0::DOUBLE - q2::DOUBLE))::FLOAT AS base, q2 AS alpha, NOT (mv <> 0 AND q2 <= {dbl(P.WRITER_GATE)}::FLOAT) AS gate2
        FROM (SELECT *, CASE WHEN p2 < 0 THEN -p2 ELSE p2 END AS q2 FROM means JOIN states ON done = (y + 1) // 8)""",
    ),
    "cal": ("setter dims", "SELECT a.*, b.base AS base_score, c.base AS base_write FROM setter a, dims d, setter b, setter c WHERE b.y = least(a.y + 1, d.h - 1) AND c.y = least(a.y + 6, d.h - 1)"),
    "aux": ("work cal", "SELECT w.*, base_score, base_write, ((wi::DOUBLE - alpha::DOUBLE * wr::DOUBLE) / (1.0::DOUBLE - alpha::DOUBLE) - 1.0::DOUBLE)::FLOAT AS aux FROM work w JOIN cal USING (y)"),
    "scored": (
        "aux dims",
        f"""SELECT *, score * aux AS sa, score * wr AS sr, score * wg AS sg, score * wb AS sb FROM (SELECT *,
        greatest(least(((base_score::DOUBLE + {dbl(P.SCORE_ADDEND)}) - s::DOUBLE) * {dbl(P.SCORE_SCALE)} + 1.0::DOUBLE, 1.0::DOUBLE), {dbl(P.SCORE_FLOOR)})::FLOAT AS score FROM (
        SELECT *, CASE WHEN x = 0 OR x = w - 1 THEN aux ELSE least(lag(aux) OVER r, aux, lead(aux) OVER r) END AS s FROM aux, dims WINDOW r AS (PARTITION BY y ORDER BY x)))""",
    ),
    "lows": ("aux", f"SELECT y, x, (aux < {dbl(P.DECISION_THRESHOLD)}::FLOAT)::INT AS low FROM aux"),
    "taps": ("", "SELECT 0 AS bar, k AS dy, -4 AS dx FROM range(-4, 5) t(k) UNION ALL SELECT 2, -4, k FROM range(-4, 5) t(k) UNION ALL SELECT 1, k, 4 FROM range(-4, 5) t(k) UNION ALL SELECT 3, 4, k FROM range(-4, 5) t(k)"),
    "bars": (
        "lows taps dims",
        """SELECT p.y, p.x, bar, sum(q.low)::INT AS edged, sum(CASE WHEN there THEN q.low ELSE 0 END)::INT AS inside, sum(there::INT) AS n
        FROM (SELECT y, x, bar, least(greatest(y + dy, 0), h - 1) AS qy, least(greatest(x + dx, 0), w - 1) AS qx, y + dy BETWEEN 0 AND h - 1 AND x + dx BETWEEN 0 AND w - 1 AS there FROM lows, taps, dims) p
        JOIN lows q ON q.y = p.qy AND q.x = p.qx GROUP BY ALL""",
    ),
    "decided": ("bars", "SELECT y, x, max(edged) > 8 AS fallback, min(n) < 9 AS boundary, max(inside) > 8 OR min(n) < 9 AS strict FROM bars GROUP BY y, x"),
    "eligible": ("decided scored", "SELECT s.*, fallback, NOT fallback AND score < 1 AS eligible FROM scored s JOIN decided USING (y, x)"),
    "pad": (
        "scored dims",
        f"""SELECT y, x, aux, score, sa, sr, sg, sb, false AS pad FROM scored
        UNION ALL SELECT -1, x, aux, {FLOOR}, aux * {FLOOR}, wr * {FLOOR}, wg * {FLOOR}, wb * {FLOOR}, true FROM scored WHERE y = 0
        UNION ALL SELECT y + k, x, aux, score, sa, sr, sg, sb, true FROM scored, range(1, 6) t(k) WHERE y = h - 1""",
    ),
    "vertical": ("pad", _vertical()),
    "averages": ("vertical", _averages()),
    "features": ("averages", _features()),
    "ranges": ("features", _ranges()),
    "candidates": ("ranges", _candidates()),
    "combined": ("candidates eligible", _combined()),
    # regions
    "mask": ("scored", f"SELECT y, x, score = {FLOOR} AS mask FROM scored"),
    "runs": ("mask", "SELECT *, row_number() OVER (ORDER BY y, x0) AS id FROM (SELECT y, min(x) AS x0, max(x) AS x1 FROM (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM mask WHERE mask) GROUP BY y, g)"),
    "touch": ("runs", "SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON abs(a.y - b.y) <= 1 AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1"),
    "reach": ("touch", "SELECT a, b FROM touch UNION SELECT r.a, t.b FROM reach r JOIN touch t ON r.b = t.a"),
    "labels": ("reach runs", "SELECT y, unnest(range(x0, x1 + 1))::INT AS x, dense_rank() OVER (ORDER BY root)::INT AS label FROM runs JOIN (SELECT a, min(b) AS root FROM reach GROUP BY a) ON a = id"),
    "dist": ("mask", "SELECT m.y, m.x, min(greatest(abs(m.y - n.y), abs(m.x - n.x)))::INT AS distance FROM mask m, mask n WHERE m.mask AND NOT n.mask GROUP BY ALL"),
    "regions": (
        "labels dist dims",
        """SELECT *, CASE WHEN area >= 400 AND radius >= 5 THEN 'area+chessboard_radius' WHEN area >= 400 THEN 'area' WHEN radius >= 5 THEN 'chessboard_radius' ELSE 'not_routed' END AS reason FROM (
        SELECT label, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, count(*) AS area, max(distance) AS radius, sum((y = 0 OR x = 0 OR y = h - 1 OR x = w - 1)::INT) = any_value(2 * (h + w) - 4) AS perimeter
        FROM labels JOIN dist USING (y, x), dims GROUP BY label)""",
    ),
    "routed": ("labels regions", "SELECT y, x FROM labels JOIN regions USING (label) WHERE reason <> 'not_routed' AND NOT perimeter"),
    "synth": (
        "mask labels regions routed",
        """SELECT m.y, m.x, m.mask AS at_floor, l.label, r.y IS NOT NULL AS dilated, r.y IS NOT NULL AND NOT coalesce(g.perimeter, false) AS synth
        FROM mask m LEFT JOIN labels l USING (y, x) LEFT JOIN regions g USING (label)
        LEFT JOIN (SELECT DISTINCT y + a AS y, x + b AS x FROM routed, range(-4, 5) s(a), range(-4, 5) t(b)) r ON r.y = m.y AND r.x = m.x""",
    ),
    "fruns": ("synth", "SELECT *, row_number() OVER (ORDER BY y, x0) AS id FROM (SELECT y, min(x) AS x0, max(x) AS x1 FROM (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM synth WHERE synth) GROUP BY y, g)"),
    "ftouch": ("fruns", "SELECT a.id AS a, b.id AS b FROM fruns a JOIN fruns b ON abs(a.y - b.y) <= 1 AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1"),
    "freach": ("ftouch", "SELECT a, b FROM ftouch UNION SELECT r.a, t.b FROM freach r JOIN ftouch t ON r.b = t.a"),
    "fpix": ("freach fruns", "SELECT y, unnest(range(x0, x1 + 1))::INT AS x, root FROM fruns JOIN (SELECT a, min(b) AS root FROM freach GROUP BY a) ON a = id"),
    "final": (
        "fpix",
        "SELECT y, x, final FROM fpix JOIN (SELECT root, row_number() OVER (ORDER BY min(y), min(x), max(y), max(x), root)::INT AS final FROM fpix GROUP BY root) USING (root)",
    ),
    "pairs": ("synth final", "SELECT label, final, count(*) AS n FROM synth JOIN final USING (y, x) WHERE label IS NOT NULL GROUP BY ALL"),
    "disposed": (
        "regions pairs",
        """SELECT r.*, coalesce(f, []) AS final_ids, CASE WHEN perimeter THEN 'perimeter_excluded' WHEN reason <> 'not_routed' THEN 'routed' WHEN n > 0 THEN 'absorbed' ELSE 'pristine' END AS disposition,
        CASE WHEN reason = 'not_routed' AND NOT perimeter THEN coalesce(n, 0) ELSE 0 END::BIGINT AS absorbed_pixels
        FROM regions r LEFT JOIN (SELECT label, list_sort(list(DISTINCT final)) AS f, sum(n) AS n FROM pairs GROUP BY label) USING (label)""",
    ),
    "boxes": ("final dims", "SELECT final, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, count(*) AS n_pixels, greatest(0, min(y) - 128) AS cy0, greatest(0, min(x) - 128) AS cx0, least(any_value(h), max(y) + 129) AS cy1, least(any_value(w), max(x) + 129) AS cx1 FROM final, dims GROUP BY final"),
    "crop": ("boxes px synth final", "SELECT b.final, p.y, p.x, p.r, p.g, p.b, s.synth, coalesce(f.final = b.final, false) AS own FROM boxes b JOIN px p ON p.y >= cy0 AND p.y < cy1 AND p.x >= cx0 AND p.x < cx1 JOIN synth s USING (y, x) LEFT JOIN final f USING (y, x)"),
    "context": ("crop", "SELECT final, count(*) FILTER (NOT synth) AS n_context, " + ", ".join(f"min({c}) FILTER (NOT synth) AS lo_{c}, max({c}) FILTER (NOT synth) AS hi_{c}" for c in "rgb") + " FROM crop GROUP BY final"),
    "feather": ("final mask", "SELECT y, x, final, least(3, min(d))::INT AS distance, least(3, min(d)) / 3.0::DOUBLE AS alpha FROM (SELECT f.y, f.x, f.final, greatest(abs(f.y - m.y), abs(f.x - m.x)) AS d FROM final f, mask m LEFT JOIN final g ON g.y = m.y AND g.x = m.x WHERE g.final IS DISTINCT FROM f.final) GROUP BY y, x, final"),
    "enc": ("crop context", "SELECT c.final, c.y, c.x, own, " + ", ".join(f"(CASE WHEN lo_{c} = hi_{c} THEN 0 ELSE least(greatest(floor(({c} - lo_{c})::DOUBLE * 255.0::DOUBLE / (hi_{c} - lo_{c})::DOUBLE + 0.5::DOUBLE), 0), 255) END)::INT AS e_{c}, lo_{c}, hi_{c}" for c in "rgb") + " FROM crop c JOIN context USING (final)"),
    "fills": ("enc", "SELECT final, " + ", ".join(f"(2 * sum(e_{c}) + count(*)) // (2 * count(*)) AS m8_{c}, any_value(lo_{c}) AS lo_{c}, any_value(hi_{c}) AS hi_{c}" for c in "rgb") + " FROM enc WHERE NOT own GROUP BY final"),
    "image": (
        "px feather fills",
        "SELECT p.y, p.x, " + ", ".join(f"(CASE WHEN alpha IS NULL THEN p.{c} ELSE least(greatest(floor(p.{c}::DOUBLE * (1.0::DOUBLE - alpha) + least(greatest(floor(lo_{c}::DOUBLE + m8_{c}::DOUBLE * (hi_{c} - lo_{c})::DOUBLE / 255.0::DOUBLE + 0.5::DOUBLE), 0), 65535)::DOUBLE * alpha + 0.5::DOUBLE), 0), 65535) END)::INT AS {c}" for c in "rgb") + " FROM px p LEFT JOIN feather USING (y, x) LEFT JOIN fills USING (final)",
    ),
    # prepass
    "pre": ("px", "SELECT y // 2 AS y, x // 2 AS x, r, g, b, ir FROM px WHERE y % 2 = 0 AND x % 2 = 0"),
    "prew": ("pre", f"SELECT *, {resp('r')} AS wr, {resp('ir')} AS wi, y // 8 AS ty, x // 8 AS tx, 2 * ((y % 8) // 4) + (x % 8) // 4 AS q FROM pre"),
    "ptile": ("prew", f"SELECT ty, tx, count(*) AS n_valid, sum(ir)::BIGINT AS raw FROM prew WHERE ir > {THR} GROUP BY ty, tx"),
    "psum": ("prew", f"SELECT {fold('ir::DOUBLE * ir::DOUBLE * wr::DOUBLE', 'ty, tx, y, x')} AS sr, {fold('ir::DOUBLE * ir::DOUBLE * wi::DOUBLE', 'ty, tx, y, x')} AS si, {fold('ir::DOUBLE * ir::DOUBLE', 'ty, tx, y, x')} AS s2, count(*) AS n FROM prew WHERE ir > {THR}"),
    # the writer's walk: one item for each channel of a valid site, in order; a state goes from item to item
    "sites": ("combined work", "SELECT y, x, row_number() OVER (ORDER BY y, x) AS site, wr, wg, wb, kr, kg, kb, isfinite(kr) AND isfinite(kg) AND isfinite(kb) AND kr > 0 AND kg > 0 AND kb > 0 AS valid FROM combined JOIN work USING (y, x)"),
    "items": (
        "sites",
        "SELECT *, row_number() OVER (ORDER BY site, c) AS i, (4.0::DOUBLE / ((hi - lo) * (hi - lo))) * 1.0::DOUBLE AS scale, lo < v AND v < hi AS inside FROM (SELECT *, k::FLOAT::DOUBLE AS v, "
        + f"({resp('655')})::DOUBLE AS lo, ({resp('64879')})::DOUBLE AS hi FROM (" + " UNION ALL ".join(f"SELECT site, {i} AS c, k{c} AS k, w{c}::DOUBLE AS o, {dbl(P.DITHER_SCALES[i])} AS d FROM sites WHERE valid" for i, c in enumerate("rgb")) + "))",
    ),
    "shaped": ("items", "SELECT *, ((hi - v) * (v - lo)) * scale AS env, (d * v)::FLOAT::DOUBLE AS span FROM items"),
    "walked": (
        "shaped",
        f"SELECT 0::BIGINT AS i, {P.LCG_SEED}::BIGINT AS state, 0::BIGINT AS draws, 0.0::DOUBLE AS value UNION ALL SELECT i, CASE WHEN NOT inside THEN s0 WHEN k + d1 <= o THEN s1 ELSE s2 END, "
        "draws + CASE WHEN NOT inside THEN 0 WHEN k + d1 <= o THEN 1 ELSE 2 END, CASE WHEN k + d1 <= o THEN o WHEN inside AND lo < v + m2 AND v + m2 < hi THEN k + m2 ELSE k END FROM (SELECT *, CASE WHEN inside AND lo < v + m1 AND v + m1 < hi THEN m1 ELSE 0.0::DOUBLE END AS d1 FROM ("
        f"SELECT *, env * (((s1 + 1)::DOUBLE * {dbl(P.LCG_UNIT)} - 0.5::DOUBLE) * span) AS m1, env * (((s2 + 1)::DOUBLE * {dbl(P.LCG_UNIT)} - 0.5::DOUBLE) * span) AS m2 FROM ("
        f"SELECT t.*, w.state AS s0, w.draws AS draws, (w.state * 125 + 1) & {P.LCG_MASK} AS s1, (((w.state * 125 + 1) & {P.LCG_MASK}) * 125 + 1) & {P.LCG_MASK} AS s2 FROM walked w JOIN shaped t ON t.i = w.i + 1)))",
    ),
    "ends": ("walked", "SELECT arg_max(state, i) AS state, max(draws) AS draws FROM walked"),
    "written": (
        "sites items walked",
        "SELECT s.y, s.x, " + ", ".join(f"coalesce(max(value) FILTER (c = {i}), any_value(w{c}::DOUBLE))::FLOAT AS v{c}" for i, c in enumerate("rgb")) + " FROM sites s LEFT JOIN (items JOIN walked USING (i)) t ON s.site = t.site GROUP BY s.y, s.x",
    ),
    "output": (
        "work written",
        "SELECT *, attempted AND (coalesce(dr, false) OR coalesce(dg, false) OR coalesce(db, false)) AS written, r <> nr OR g <> ng OR b <> nb AS changed FROM (SELECT w.y, w.x, v.vr IS NOT NULL AS attempted, "
        + ", ".join(f"{inverse(index(f'coalesce(v.v{c}, w.w{c})'))} AS {c}, {inverse(index(f'w.w{c}'))} AS n{c}, v.v{c} <> w.w{c} AS d{c}" for c in "rgb") + " FROM work w LEFT JOIN written v USING (y, x))",
    ),
    # the prepass regression: narrowed after every tile, so it goes from tile to tile
    "pquad": ("prew", f"SELECT ty, tx, q, (sum(wr::DOUBLE) * 0.0625::DOUBLE)::FLOAT AS mr, (sum(wi::DOUBLE) * 0.0625::DOUBLE)::FLOAT AS mi FROM prew WHERE ir > {THR} GROUP BY ty, tx, q"),
    "pwhole": ("pquad ptile", f"SELECT ty, tx, ({fold('mr::DOUBLE', 'q')} * 0.25::DOUBLE)::FLOAT AS ar, ({fold('mi::DOUBLE', 'q')} * 0.25::DOUBLE)::FLOAT AS ai, any_value(raw)::FLOAT::DOUBLE AS raw FROM pquad JOIN ptile USING (ty, tx) WHERE n_valid = 64 GROUP BY ty, tx"),
    "pterm": (
        "pquad pwhole",
        f"SELECT ty, tx, q, dr * dr * raw * raw AS w, ratio, dr <> 0 AND ratio >= {dbl(P.PREPASS_RATIO[0])} AND ratio <= {dbl(P.PREPASS_RATIO[1])} AS use FROM (SELECT *, di / dr AS ratio FROM ("
        "SELECT ty, tx, q, raw, (mr - ar)::DOUBLE AS dr, (mi - ai)::DOUBLE AS di FROM pquad JOIN pwhole USING (ty, tx)))",
    ),
    "pstep": ("pterm", "SELECT row_number() OVER (ORDER BY ty, tx) AS n, list(struct_pack(w := w, r := ratio) ORDER BY q) FILTER (use) AS terms FROM pterm GROUP BY ty, tx"),
    "pfold": (
        "pstep",
        "SELECT 0::BIGINT AS n, 0.0::FLOAT AS den, 0.0::FLOAT AS num UNION ALL SELECT s.n, "
        "list_reduce(list_prepend(f.den::DOUBLE, coalesce(list_transform(s.terms, lambda t: t.w), [])), lambda a, b: a + b)::FLOAT, "
        "list_reduce(list_prepend(f.num::DOUBLE, coalesce(list_transform(s.terms, lambda t: t.r * t.w), [])), lambda a, b: a + b)::FLOAT FROM pfold f JOIN pstep s ON s.n = f.n + 1",
    ),
    "prec": (
        "pfold psum",
        f"SELECT n AS full_tiles, ratio::FLOAT AS alpha, (ratio * 1.5::DOUBLE)::FLOAT AS alpha_scaled, den, num, mv, mi, sr, si, s2 FROM (SELECT n, den, num, CASE WHEN den = 0 THEN {dbl(P.PREPASS_ZERO_ALPHA)} ELSE num::DOUBLE / den::DOUBLE END AS ratio FROM pfold ORDER BY n DESC LIMIT 1), "
        "(SELECT sr, si, s2, (sr / s2)::FLOAT AS mv, (si / s2)::FLOAT AS mi FROM psum)",
    ),
}
RECURSIVE = {"cum", "states", "reach", "freach", "walked", "pfold"}


def sql(last: str, *needs: str) -> str:
    """The statement `last` with all steps that it needs, in order."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for n in STEPS[name][0].split():
                add(n)
            done.append(name)

    for n in needs:
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({STEPS[n][1]})" if n in RECURSIVE else f"{n} AS MATERIALIZED ({STEPS[n][1]})" for n in done) + " " + last
