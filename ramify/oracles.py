"""SQL of whole trees: the stems, the turtle's state rows and the voxels of the networks of the queries' parameters."""

from __future__ import annotations

from .functions import physics, rng
from .plans.grammar import DRAWS, START, TURNS

#: The properties' defaults; all networks have these exponents and spreads.
K, EPSILON, MARGIN, SIGMA = (float(physics.DEFAULTS[c]) for c in ("k", "epsilon", "randmarg", "sigma"))

#: Networks, as queries.parameters has them: seed, levels, diameter, and the properties of lengths.
PARAMS = f"SELECT s_suppkey network_id, 11 seed, CAST(s_suppkey % 3 + 6 AS INT) n, CAST(s_suppkey % 11 + 15 AS DOUBLE) d, {EPSILON}::DOUBLE ep, {MARGIN}::DOUBLE mg FROM supplier"


def uniform(name: str, path: str = "path") -> str:
    return rng.uniform_sql("CAST(seed AS VARCHAR)", "CAST(network_id AS VARCHAR)", path, f"'{name}'")


def normal(name: str) -> str:
    return rng.normal_sql(f"u_{name}a", f"u_{name}b")


def between(u: str, low: float, high: float) -> str:
    return f"({low}::DOUBLE + {u} * {high - low}::DOUBLE)"


def tail(v: str) -> str:
    """The further turn of a negative operand."""
    power = f"pow(10.0::DOUBLE, floor(log10(abs({v}))))"
    return f"(CASE WHEN {v} >= 0 THEN 0.0::DOUBLE WHEN abs({v}) < 1 THEN abs({v}) ELSE abs({v}) - floor(abs({v}) / {power}) * {power} END)"


def daughters(d: str, name: str, out: tuple[str, str]) -> str:
    """Diameters and angles of a fork, as three nested selects around {src}."""
    a, b = out
    best = f"({d} / pow(2.0::DOUBLE, 1.0::DOUBLE / {K}::DOUBLE))"
    draw = f"abs({best} + {best} / {SIGMA}::DOUBLE * {normal(name)})"
    inside = lambda c: f"degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {c}))))"
    two = f"(pow(pow({d}, {K}::DOUBLE) - pow({a}, {K}::DOUBLE), 1.0::DOUBLE / {K}::DOUBLE))"
    full, root, four = f"pow({name}s, 4.0::DOUBLE / 3)", f"pow({name}s, 2.0::DOUBLE / 3)", f"pow({name}q, 4.0::DOUBLE)"
    return (
        f"(SELECT *, {inside(f'({full} + 1.0 - {four}) / ({root} * 2.0)')} {name}1, {inside(f'({full} + {four} - 1.0) / ({name}q * {name}q * 2.0 * {root})')} {name}2 FROM "
        f"(SELECT *, 1.0::DOUBLE + {name}q * {name}q * {name}q {name}s FROM (SELECT *, {b} / {a} {name}q FROM (SELECT *, {two} {b} FROM "
        f"(SELECT *, CASE WHEN {draw} >= {d} THEN {best} ELSE {draw} END {a} FROM {{src}})))))"
    )


STATE = ("x", "y", "z", "al", "be", "dm", "ls", "dx", "dy", "dz")
#: Rows that a tree of m levels has after its start row.
SIZE = "(CASE WHEN {m} = 0 THEN 1 ELSE CAST(pow(2, {m} + 3) AS BIGINT) - 9 END)"


def grown(src: str) -> str:
    """The nodes of src with the states behind each of their five steps and the fork's diameters and angles.

    A node of two levels turns but does not move; one of a single level does neither.
    """
    at = f"(SELECT *, {', '.join(f'{uniform(d)} u_{d}' for d in DRAWS)} FROM {src})"
    at = daughters("d", "s", ("sd1", "sd2")).format(src=at)
    at = daughters("d", "f", ("fd1", "fd2")).format(src=at)
    up = "list_sort([" + ", ".join(between(f"u_g{i}", 1.0, 1.5) for i in range(3)) + "])"
    down = "list_reverse_sort([" + ", ".join(between(f"u_h{i}", 1.0, 1.5) for i in range(2)) + "])"
    ones = "[" + ", ".join(["1.0::DOUBLE"] * 5) + "]"
    at = (
        f"(SELECT *, s1 * (CAST(floor(u_rho * 3.0) AS INT) - 1) turn0, s2 * abs(CAST(floor(u_rho * 3.0) AS INT) - 1) turn1, "
        f"CASE WHEN u_taper < 0.1 THEN list_concat({up}, {down}) ELSE {ones} END widths FROM {at})"
    )
    last = dict(zip(STATE, STATE))
    for i in range(5):
        now = {c: f"{c}_{i}" for c in STATE}
        wide = f"(widths[{i + 1}] * d)"
        low, high = f"({wide} * ep - mg)", f"({wide} * ep + mg)"
        sign = f"(CASE WHEN u_rule < 0.5 THEN {TURNS[True][i - 1]}.0 ELSE {TURNS[False][i - 1]}.0 END)" if i else ""
        turn = f"turn{(i - 1) % 2}"
        turned = f"CASE WHEN lv >= 2 THEN {last['al']} + ({sign} * {turn} - {tail(turn)}) ELSE {last['al']} END" if i else last["al"]
        x, y, z = (last[c] for c in "xyz")
        at = f"(SELECT *, ({low} + u_c{i} * ({high} - {low})) / 5.0::DOUBLE go{i}, {turned} pre{i}, {wide} wide{i}, sqrt({x} * {x} + {y} * {y} + {z} * {z}) size{i}, lv >= 3 mv{i} FROM {at})"
        a, b, part = f"radians(pre{i})", f"radians({last['be']})", f"(CASE WHEN size{i} = 0 THEN 0 ELSE go{i} / size{i} END)"
        fall = f"(sin({a}) * {y} + cos({a}) * {z})"
        moves = {"dx": f"{part} * (cos({b}) * {x} + sin({b}) * {fall})", "dy": f"{part} * (cos({a}) * {y} - sin({a}) * {z})", "dz": f"{part} * (cos({b}) * {fall} - sin({b}) * {x})"}
        at = f"(SELECT *, {', '.join(f'CASE WHEN mv{i} THEN {v} ELSE {last[c]} END {now[c]}' for c, v in moves.items())} FROM {at})"
        then = {c: f"CASE WHEN mv{i} THEN {last[c]} + {now['d' + c]} ELSE {last[c]} END" for c in "xyz"}
        then |= {"al": f"CASE WHEN mv{i} THEN pre{i} - {tail(f'go{i}')} ELSE pre{i} END", "be": last["be"]}
        then |= {"dm": f"CASE WHEN mv{i} AND wide{i} > 0 THEN wide{i} ELSE {last['dm']} END", "ls": f"CASE WHEN mv{i} THEN go{i} ELSE {last['ls']} END"}
        at = f"(SELECT *, {', '.join(f'{v} {now[c]}' for c, v in then.items())} FROM {at})"
        last = now
    return at


_KEPT = ["network_id", "seed", "ep", "mg", "n", "lv", "path", "d", "off", *STATE, *[f"{c}_{i}" for i in range(5) for c in STATE], *(f"f{c}" for c in ("d1", "d2", "1", "2")), "u_t1", "u_u1", "u_t2", "u_u2", *(f"go{i}" for i in range(5))]


def nodes(least: int = 0, params: str = PARAMS) -> str:
    """WITH RECURSIVE nodes: every node of the networks' trees with at least `least` levels left (lv), level by level.

    off is the number of its first state row; state columns without a number are those where it opens.
    """
    start = f"SELECT network_id, seed, ep, mg, n, n lv, '' path, d, 1::BIGINT off, {', '.join(f'{v}::DOUBLE {c}' for c, v in zip('xyz', START))}, 0.0::DOUBLE al, 0.0::DOUBLE be, d dm, 1.0::DOUBLE ls, 0.0::DOUBLE dx, 0.0::DOUBLE dy, 0.0::DOUBLE dz FROM ({params})"
    tilt = lambda i: f"({between(f'u_t{i}', 22.5, 27.5)} * (CAST(floor(u_u{i} * 3.0) AS INT) - 1))"
    own = "CASE WHEN lv >= 2 THEN 5 ELSE 1 END"
    child = []
    for i in (1, 2):
        # The last of the numbered states is a node's end, whatever it did.
        state = {c: f"{c}_4" for c in STATE} | {"al": f"al_4 + f{i} * {1 if i == 1 else -1} - {tail(tilt(i))}", "be": f"be_4 + {tilt(i)}"}
        off = f"off + {own}" + (f" + {SIZE.format(m='(lv - 1)')} + 2" if i == 2 else "")
        child.append(f"SELECT network_id, seed, ep, mg, n, lv - 1 lv, path || '{i}' path, fd{i} d, {off} off, {', '.join(f'{v} {c}' for c, v in state.items())} FROM nodes WHERE lv - 1 >= {least} AND lv >= 1")
    kept = ", ".join(_KEPT)
    return f"WITH RECURSIVE nodes AS (SELECT {kept} FROM {grown(f'({start})')} UNION ALL SELECT {kept} FROM {grown('(' + ' UNION ALL '.join(child) + ')')})"


def stem_points(digits: int | None = 4) -> str:
    """network_id, run, window, pos, x, y, z and diam of the stems' points."""
    shown = lambda c: f"round({c}, {digits}) + 0.0" if digits is not None else c
    parts = [
        f"SELECT network_id, path AS run, 0::BIGINT AS win, {k}::INT AS pos, " + ", ".join(f"{shown(c + (f'_{k - 1}' if k else ''))} {n}" for c, n in (("x", "x"), ("y", "y"), ("z", "z"), ("dm", "diam"))) + " FROM nodes WHERE lv >= 3"
        for k in range(6)
    ]
    return " UNION ALL ".join(parts)


def state_rows(digits: int = 4) -> str:
    """network_id, seq, is_gap and the state of every row that the turtle writes for the networks' texts; -1 stands for no
    number."""
    names = dict(zip(STATE, ("x", "y", "z", "alpha", "beta", "diam", "lseg", "dx", "dy", "dz")))
    show = lambda k: ", ".join(f"round({c}{k}, {digits}) + 0.0 {names[c]}" for c in STATE)
    end = f"off + {SIZE.format(m='(lv - 1)')} + CASE WHEN lv >= 2 THEN 5 ELSE 1 END"
    gone = ", ".join(f"-1.0::DOUBLE {n}" for n in names.values())
    parts = [f"SELECT network_id, 0::BIGINT seq, false is_gap, {show('')} FROM nodes WHERE path = ''"]
    for k in range(5):
        # A negative length turns behind its step's row.
        own = show(f"_{k}").replace(f"round(al_{k},", f"round(CASE WHEN lv >= 3 THEN al_{k} + {tail(f'go{k}')} ELSE al_{k} END,")
        parts.append(f"SELECT network_id, off + {k} seq, false is_gap, {own} FROM nodes WHERE lv >= {2 if k else 1}")
    parts += [f"SELECT network_id, off seq, false is_gap, {show('')} FROM nodes WHERE lv = 0"]
    # Behind each child: a gap, and its parent's end again.
    for i in (1, 2):
        at = end + (f" + {SIZE.format(m='(lv - 1)')} + 2" if i == 2 else "")
        parts.append(f"SELECT network_id, {at} seq, true is_gap, {gone} FROM nodes WHERE lv >= 1")
        parts.append(f"SELECT network_id, {at} + 1 seq, false is_gap, {show('_4')} FROM nodes WHERE lv >= 1")
    return " UNION ALL ".join(parts)


def rule_texts(params: str = PARAMS) -> str:
    """network_id, rule, shape, k and value: the numbers in every rule's text of one level (S2, B2: of two), in order."""
    long = lambda name, d="d": f"({d} * ep - mg + u_{name} * ({d} * ep + mg - ({d} * ep - mg)))"
    tilt = lambda i: f"({between(f'u_t{i}', 22.5, 27.5)} * (CAST(floor(u_u{i} * 3.0) AS INT) - 1))"
    spin = between("u_t1", 22.5, 27.5)

    def base(path: str) -> str:
        at = f"(SELECT *, {', '.join(f'{uniform(d)} u_{d}' for d in DRAWS)} FROM (SELECT *, '{path}' path FROM ({params})))"
        return daughters("d", "f", ("fd1", "fd2")).format(src=daughters("d", "s", ("sd1", "sd2")).format(src=at))

    up = "list_sort([" + ", ".join(between(f"u_g{i}", 1.0, 1.5) for i in range(3)) + "])"
    down = "list_reverse_sort([" + ", ".join(between(f"u_h{i}", 1.0, 1.5) for i in range(2)) + "])"
    wide = [f"(CASE WHEN u_taper < 0.1 THEN list_concat({up}, {down})[{i + 1}] ELSE 1.0::DOUBLE END * d)" for i in range(5)]
    turn = ["s1 * (CAST(floor(u_rho * 3.0) AS INT) - 1)", "s2 * abs(CAST(floor(u_rho * 3.0) AS INT) - 1)"]
    signed = lambda step: "CASE WHEN u_rule < 0.5 THEN '" + "' ELSE '".join("{" + step + "".join(f"{'+' if x > 0 else '-'}(#){step}" for x in TURNS[own]) + "}" for own in (True, False)) + "' END"
    steps = [v for i in range(5) for v in ([turn[(i - 1) % 2]] if i else []) + [f"{long(f'c{i}', wide[i])} / 5.0::DOUBLE", wide[i]]]
    fork = "{S}[+(#)A][+(#)A"
    rules = [
        ("F", "'{S}[+(#)/(#)F][-(#)/(#)F]'", ["f1", tilt(1), "f2", tilt(2)]),
        ("S", signed("D"), [turn[i % 2] for i in range(4)]),
        ("S2", signed("f(#,#)"), steps),
        ("D", "'f(#,#)'", [f"{long('c0')} / 5.0::DOUBLE", "d"]),
        ("G", "'f(#,#)'", [f"{long('c0')} / 5.0::DOUBLE", "d"]),
        ("A", f"'{fork}'", ["f1", "f2"]),
        ("B", "'DDD/(#)A'", [spin]),
        ("B2", f"'f(#,#)f(#,#)f(#,#)/(#){fork}'", [v for i in range(3) for v in (f"{long(f'c{i}')} / 5.0::DOUBLE", "d")] + [spin, "n1", "n2"]),
        ("R", "'f(#)DDD[B]f(#,#)B'", [f"{long('c3')} / 3.0::DOUBLE", f"{long('c3')} / 2.0::DOUBLE", "fd2"]),
        ("I", "'f(#,#)+(#)[R]'", [f"{long('c0')} / 3.0::DOUBLE", "d", spin]),
    ]
    listed = lambda values: "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in values) + "]"
    parts = [f"SELECT network_id, '{name}' AS rule, {shape} AS shape, {listed(values)} AS v FROM base" for name, shape, values in rules]
    return (
        f"WITH base AS (SELECT a.*, b.f1 n1, b.f2 n2 FROM {base('')} a JOIN {base('1')} b USING (network_id)), texts AS ({' UNION ALL '.join(parts)}) "
        "SELECT network_id, rule, shape, CAST(k - 1 AS INT) k, round(v[k], 5) + 0.0 AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) k FROM texts)"
    )


def _token(op: str, a: str = "0", b: str = "0") -> str:
    return f"{{'op': '{op}', 'a': CAST({a} AS DOUBLE), 'b': CAST({b} AS DOUBLE)}}"


def interpreted(tokens: str, starts: str, digits: int = 5) -> str:
    """State rows by recursion over tokens: CTEs up to tokens (id, t, i from 1), and starts, a query of id and diameter."""
    names = ("x", "y", "z", "alpha", "beta", "diam", "lseg", "dx", "dy", "dz")
    state = "{" + ", ".join(f"'{c}': {c}" for c in names) + "}"
    size, fall = "sqrt(x * x + y * y + z * z)", "(sin(radians(alpha)) * y + cos(radians(alpha)) * z)"
    part = f"(CASE WHEN {size} = 0 THEN 0 ELSE t.a / {size} END)"
    move = {
        "dx": f"{part} * (cos(radians(beta)) * x + sin(radians(beta)) * {fall})",
        "dy": f"{part} * (cos(radians(alpha)) * y - sin(radians(alpha)) * z)",
        "dz": f"{part} * (cos(radians(beta)) * {fall} - sin(radians(beta)) * x)",
    }
    went = {c: f"CASE WHEN t.op = 'f' THEN {{}} WHEN t.op = ']' THEN stack[-1].{c} ELSE {c} END" for c in names}
    new = {c: went[c].format(f"{c} + {move['d' + c]}") for c in "xyz"} | {c: went[c].format(v) for c, v in move.items()}
    new |= {"lseg": went["lseg"].format("t.a"), "diam": went["diam"].format("CASE WHEN t.b > 0 THEN t.b ELSE diam END")}
    new["alpha"] = "CASE t.op WHEN '+' THEN alpha + t.a WHEN '-' THEN alpha - t.a WHEN ']' THEN stack[-1].alpha ELSE alpha END"
    new["beta"] = "CASE t.op WHEN '/' THEN beta + t.a WHEN ']' THEN stack[-1].beta ELSE beta END"
    stack = f"CASE t.op WHEN '[' THEN list_append(stack, {state}) WHEN ']' THEN stack[:-2] ELSE stack END"
    shown = ", ".join(f"round({c}, {digits}) + 0.0 {c}" for c in names)
    gone = ", ".join(f"-1.0::DOUBLE {c}" for c in names)
    return f"""{tokens},
 run AS (SELECT id, 0::BIGINT i, '' op, 0::BIGINT seq, 0.1::DOUBLE x, 0.1::DOUBLE y, 1.0::DOUBLE z, 0.0::DOUBLE alpha, 0.0::DOUBLE beta, diam, 1.0::DOUBLE lseg, 0.0::DOUBLE dx, 0.0::DOUBLE dy, 0.0::DOUBLE dz,
  CAST([] AS STRUCT({', '.join(f'{c} DOUBLE' for c in names)})[]) stack FROM ({starts})
  UNION ALL SELECT id, i, t.op, seq + CASE t.op WHEN ']' THEN 2 WHEN 'f' THEN 1 WHEN 'D' THEN 1 ELSE 0 END, {', '.join(new[c] for c in names)}, {stack}
  FROM (SELECT run.* EXCLUDE (i), tokens.i, tokens.t FROM run JOIN tokens ON run.id = tokens.id AND tokens.i = run.i + 1))
 SELECT id network_id, seq, false is_gap, {shown} FROM run WHERE op IN ('', 'f', 'D', ']') UNION ALL SELECT id, seq - 1, true, {gone} FROM run WHERE op = ']'"""


def commands() -> str:
    """State rows of a text for every user of events: a turtle by recursion over the tokens that each event stands for."""
    step, turn = _token("f", "l", "w"), lambda op: _token(op, "a")
    kinds = [
        [step], [turn("+")], [turn("-")], [turn("/")], [_token("["), turn("+"), step, _token("]")],
        [_token("["), step, _token("["), turn("/"), _token("f", "l"), _token("]"), turn("-"), step, _token("]")], [_token("D")],
        # A negative length turns behind its step.
        [_token("f", "-l", "w"), _token("-", "rest")],
    ]
    pieces = "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN [{', '.join(v)}]" for k, v in enumerate(kinds)) + " END"
    tokens = f"""WITH RECURSIVE given AS (SELECT user_id, event_id, (10 + event_id % 90) / 10.0::DOUBLE l, (10 + event_id % 40) / 10.0::DOUBLE w, (event_id % 180) + 0.5::DOUBLE a, (event_id % 10) / 10.0::DOUBLE rest FROM events),
 pieces AS (SELECT user_id, event_id, {pieces} toks FROM given),
 tokens AS (SELECT user_id id, t, row_number() OVER (PARTITION BY user_id ORDER BY event_id, k) i FROM (SELECT user_id, event_id, unnest(toks) t, unnest(range(0, len(toks))) k FROM pieces))"""
    return interpreted(tokens, "SELECT DISTINCT user_id id, 5.0::DOUBLE diam FROM events")


def rule_i(params: str = PARAMS) -> str:
    """State rows of the texts of rule I with four levels: I opens R, R opens B twice, and B a rule A that leaves a bracket
    open, which the bracket behind B then closes."""
    at = lambda src, path: daughters("d", "f", ("fd1", "fd2")).format(src=f"(SELECT *, {', '.join(f'{uniform(n)} u_{n}' for n in DRAWS)} FROM (SELECT network_id, seed, ep, mg, d, '{path}' path FROM ({src})))")
    below = lambda name, d: f"SELECT network_id, seed, ep, mg, {d} d FROM {name}"
    long = lambda n, name: f"({n}.d * {n}.ep - {n}.mg + {n}.u_{name} * ({n}.d * {n}.ep + {n}.mg - ({n}.d * {n}.ep - {n}.mg)))"
    spin = lambda n: between(f"{n}.u_t1", 22.5, 27.5)
    used = _token("D")

    def b(n: str, a: str) -> list[str]:
        steps = [_token("f", f"{long(n, f'c{i}')} / 5.0::DOUBLE", f"{n}.d") for i in range(3)]
        return [*steps, _token("/", spin(n)), used, _token("["), _token("+", f"{a}.f1"), used, _token("]"), _token("["), _token("+", f"{a}.f2"), used]

    listed = [_token("f", f"{long('i', 'c0')} / 3.0::DOUBLE", "i.d"), _token("+", spin("i")), _token("["), _token("f", f"{long('r', 'c3')} / 3.0::DOUBLE")]
    listed += [_token("f", f"{long('r', f'c{k}')} / 5.0::DOUBLE", "r.d") for k in range(3)]
    listed += [_token("["), *b("b1", "a1"), _token("]"), _token("f", f"{long('r', 'c3')} / 2.0::DOUBLE", "r.fd2"), *b("b2", "a2"), _token("]")]
    tokens = f"""WITH RECURSIVE i AS {at(params, '')}, r AS {at(below('i', 'd'), '1')}, b1 AS {at(below('r', 'fd1'), '11')}, b2 AS {at(below('r', 'fd2'), '12')}, a1 AS {at(below('b1', 'd'), '111')}, a2 AS {at(below('b2', 'd'), '121')},
 listed AS (SELECT i.network_id id, [{', '.join(listed)}] toks FROM i JOIN r USING (network_id) JOIN b1 USING (network_id) JOIN b2 USING (network_id) JOIN a1 USING (network_id) JOIN a2 USING (network_id)),
 tokens AS (SELECT id, unnest(toks) t, unnest(range(1, len(toks) + 1)) i FROM listed)"""
    return interpreted(tokens, f"SELECT network_id id, d diam FROM ({params})", 4)


def voxels(tissue: tuple[int, int, int], params: str = PARAMS) -> str:
    """WITH ..., voxels (network_id, x, y, z) of whole networks, from their stems' points."""
    t0, t1, t2 = tissue
    spot = lambda c, t: f"CAST(floor(CASE WHEN {c}_hi = {c}_lo THEN NULL ELSE {t}.0::DOUBLE * ({c} - {c}_lo) / ({c}_hi - {c}_lo) END) AS BIGINT) {c}"
    le = lambda a, b: f"(({b} * (2 * i - 1) + {a}) // (2 * {a}))"
    lt = lambda a, b: f"(CASE WHEN {b} > 0 THEN ({b} * (2 * i - 1) - 1 + {a}) // (2 * {a}) ELSE 0 END)"
    moved = {"x": ("i", le("ax", "ay"), le("ax", "az")), "y": (lt("ay", "ax"), "i", lt("ay", "az")), "z": (lt("az", "ax"), le("az", "ay"), "i")}
    walk = " UNION ALL ".join(
        f"SELECT network_id, r, CAST(x0 + sx * {m[0]} AS BIGINT) vx, CAST(y0 + sy * {m[1]} AS BIGINT) vy, CAST(z0 + sz * {m[2]} AS BIGINT) vz, {k} axis FROM (SELECT *, unnest(range(1, a{c} + 1)) i FROM axes)"
        for k, (c, m) in enumerate(moved.items())
    )
    return f"""{nodes(3, params)}, points AS ({stem_points(None)}),
 lim AS (SELECT network_id, {', '.join(f'{f}({c}) * 1.1::DOUBLE {c}_{e}' for c in 'xyz' for f, e in (('min', 'lo'), ('max', 'hi')))} FROM points GROUP BY network_id),
 placed AS (SELECT network_id, run, pos, {', '.join(spot(c, t) for c, t in zip('xyz', tissue))}, diam FROM points JOIN lim USING (network_id)),
 pairs AS (SELECT network_id, x x0, y y0, z z0, lead(x) OVER w x1, lead(y) OVER w y1, lead(z) OVER w z1, CAST(floor((diam + lead(diam) OVER w) / 2 * 0.5) AS BIGINT) r FROM placed WINDOW w AS (PARTITION BY network_id, run ORDER BY pos)),
 axes AS (SELECT *, abs(x1 - x0) ax, abs(y1 - y0) ay, abs(z1 - z0) az, sign(x1 - x0) sx, sign(y1 - y0) sy, sign(z1 - z0) sz FROM pairs WHERE x1 IS NOT NULL AND x0 IS NOT NULL),
 walk AS (SELECT DISTINCT * FROM ({walk})), radii AS (SELECT DISTINCT r FROM walk WHERE r >= 0),
 disc AS (SELECT r, i, j FROM (SELECT r, i, unnest(range(-r, r + 1)) j FROM (SELECT r, unnest(range(-r, r + 1)) i FROM radii)) WHERE i * i + j * j <= r * r),
 laid AS (SELECT network_id, vx + (CASE axis WHEN 0 THEN 0 ELSE i END) - 1 x, vy + (CASE axis WHEN 0 THEN i WHEN 1 THEN 0 ELSE j END) - 1 y, vz + (CASE axis WHEN 2 THEN 0 ELSE j END) - 1 z FROM walk JOIN disc USING (r)
  WHERE (CASE axis WHEN 0 THEN vx BETWEEN 0 AND {t0 - 1} WHEN 1 THEN vy BETWEEN 0 AND {t1 - 1} ELSE vz BETWEEN 0 AND {t2 - 1} END)),
 voxels AS (SELECT DISTINCT network_id, x, y, z FROM laid WHERE x BETWEEN 1 AND {t0 - 2} AND y BETWEEN 1 AND {t1 - 2} AND z BETWEEN 1 AND {t2 - 2})"""
