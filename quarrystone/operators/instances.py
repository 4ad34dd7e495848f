"""Repeated geometry: meshes that are a rotated and moved copy of an earlier one, with the placement of every copy.

Meshes with the same number of vertices, colour and mean distances (in steps of KEY_STEP) may be copies. In rounds, the earliest open
meshes of each such key stand as heads; every open mesh is held against the heads before it, first without a rotation, then with the
one that takes the head's frame to the mesh's. The frame is spanned by the same three vertices of both meshes, chosen by the head,
so vertices that are equally far cannot be mistaken for each other. A mesh belongs to the earliest head that it matches in
every vertex. As heads that match an earlier head are none themselves, this is what holding the meshes one after the other against all
before them gives. Heads double from round to round, so a key with many different shapes needs few rounds.

Most copies repeat a mesh to the last bit but for its place. Meshes of one form, that is of one key whose vertices (and normals) seen from their
first vertex are the same numbers, match the same heads with the same rotation, and each other. So only the earliest of a form takes part
in the rounds, and the others get its answer; forms are told apart by a hash of 128 bits. The vertices of all meshes are read once, to
describe them: a caller that deals them by mesh_id spares their shuffle.

Vertices stay rows: a mesh is never one array, and a head's vertices are dealt in as many shares as its key has meshes for, so that
neither a large mesh nor a shape that a third of all meshes repeat lands in one task. Only "is a mesh open" reaches the driver.

Defined cases: meshes with a null coordinate, and those without two directions (a point, a line), match nothing and have a null
``first``; those with a normal that isn't finite or an n that occurs twice match nothing and are their own ``first``; rows without mesh_id or n are no vertices; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.lineage import settled, spread, written

#: Metres of a vertex beside its place, of a normal's component, and of a step of the mean distances.
TOLERANCE, NORMAL_TOLERANCE, KEY_STEP = 1e-3, 1e-2, 0.01
#: Meshes that share a copy of a head's vertices, and the most heads of a key in a round.
SHARE, MOST_HEADS = 4096, 64
#: Meshes that are named one by one to read their vertices; more are joined.
MOST_NAMED = 1024

Vector = list[Column]


def _of(column: Column) -> Vector:
    return [column[a] for a in "xyz"]


def _minus(p: Vector, q: Vector) -> Vector:
    return [a - b for a, b in zip(p, q)]


def _dot(p: Vector, q: Vector) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def _cross(p: Vector, q: Vector) -> Vector:
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def _unit(p: Vector) -> Vector:
    size = F.sqrt(_dot(p, p))
    return [F.try_divide(a, size) for a in p]


def _length(p: Vector) -> Column:
    return F.sqrt(_dot(p, p))


def with_frame(rows: DataFrame, name: str, first: Column, second: Column, third: Column) -> DataFrame:
    """Three right-angled directions by three places, as a column of nine numbers, a direction after the other. Each step is a column
    of its own, as expressions in expressions would grow to many thousands."""
    u, v = ([F.col(k)[i] for i in range(3)] for k in ("u_", "v_"))
    steps = rows.withColumn("u_", F.array(*_unit(_minus(_of(second), _of(first))))).withColumn("along_", _dot(_minus(_of(third), _of(first)), u))
    steps = steps.withColumn("v_", F.array(*[s - F.col("along_") * c for s, c in zip(_minus(_of(third), _of(first)), u)])).withColumn("v_", F.array(*_unit(v)))
    return steps.withColumn(name, F.array(*u, *v, *_cross(u, v))).drop("u_", "v_", "along_")


def turn(before: Column, after: Column) -> Column:
    """The rotation (nine numbers, row by row) that takes one frame to another."""
    return F.array(*[reduce(Column.__add__, [after[3 * k + i] * before[3 * k + j] for k in range(3)]) for i in range(3) for j in range(3)])


def turned(rotation: Column, p: Vector) -> Vector:
    return [_dot([rotation[3 * i + j] for j in range(3)], p) for i in range(3)]


def with_quaternion(rows: DataFrame, name: str, rotation: str) -> DataFrame:
    """A column x, y, z, w of a rotation, w not negative. The products of a quaternion's parts are sums of the rotation's numbers; the
    row of products with the largest square is the quaternion but for its length."""
    m = [[F.col(rotation)[3 * i + j] for j in range(3)] for i in range(3)]
    xy, xz, yz = m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]
    wx, wy, wz = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    xx, yy, zz, ww = 1 + m[0][0] - m[1][1] - m[2][2], 1 - m[0][0] + m[1][1] - m[2][2], 1 - m[0][0] - m[1][1] + m[2][2], 1 + m[0][0] + m[1][1] + m[2][2]
    products = [F.struct(square.alias("square"), F.array(*row).alias("row")) for square, row in ((xx, [xx, xy, xz, wx]), (yy, [xy, yy, yz, wy]), (zz, [xz, yz, zz, wz]), (ww, [wx, wy, wz, ww]))]
    row = [F.col("row_")[k] for k in range(4)]
    steps = rows.withColumn("row_", F.array_max(F.array(*products))["row"])
    size = F.sqrt(row[0] * row[0] + row[1] * row[1] + row[2] * row[2] + row[3] * row[3])
    steps = steps.withColumn("scale_", F.when(row[3] < 0, -1.0).otherwise(1.0) / size)
    return steps.withColumn(name, F.struct(*[(r * F.col("scale_")).alias(a) for a, r in zip("xyzw", row)])).drop("row_", "scale_")


def _form(vertices: DataFrame, origin: Column) -> Column:
    """A hash of a mesh's vertices as seen from its first one, whatever their order: sums of the halves of two hashes a vertex."""
    seen = [F.col("n"), *_minus([F.col(a) for a in "xyz"], _of(origin))]
    for a in ("nx", "ny", "nz"):
        # hashes skip nulls
        seen += [F.col(a).isNull(), F.col(a)] if a in vertices.columns else []
    hashes = [F.xxhash64(F.lit(seed), *seen) for seed in (1, 2)]
    return F.struct(*[F.sum(part).alias(f"f{k}") for k, part in enumerate(half for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(h, 32)))])


def _sound(vertices: DataFrame, meshes: DataFrame) -> DataFrame:
    """Which meshes (mesh_id, p0) match themselves: mesh_id and ``sound``."""
    numbers = [*_minus([F.col(a) for a in "xyz"], _of(F.col("p0"))), *[F.col(a) for a in ("nx", "ny", "nz") if a in vertices.columns]]
    finite = reduce(Column.__and__, [F.coalesce(v - v, F.lit(0.0)) == 0 for v in numbers])
    return vertices.join(spread(meshes.select("mesh_id", "p0")), "mesh_id").groupBy("mesh_id").agg((F.bool_and(finite) & (F.count_distinct("n") == F.count("*"))).alias("sound"))


def _described(vertices: DataFrame) -> DataFrame:
    """A row a mesh: key, form, first place, box centre, and the numbers and places of the vertex farthest from the first one and of that
    farthest from the line of both; ``framed`` tells whether there are two directions."""
    at = F.struct("x", "y", "z")
    bare = F.count_if(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()) > 0
    colour = F.min_by("colour", "n") if "colour" in vertices.columns else F.lit(None).cast("string")
    base = vertices.groupBy("mesh_id").agg(
        F.count("*").alias("size"), bare.alias("bare"), F.min_by(at, "n").alias("p0"), colour.alias("colour"), F.struct(*[F.avg(a).alias(a) for a in "xyz"]).alias("mean"),
        F.struct(*[((F.min(a) + F.max(a)) / 2).alias(a) for a in "xyz"]).alias("centre"),
    )
    from_first, from_mean = _length(_minus(_of(at), _of(F.col("p0")))), _length(_minus(_of(at), _of(F.col("mean"))))
    steps = lambda d: F.round(F.avg(d) / KEY_STEP).cast("long")
    place = F.struct("n", "x", "y", "z")
    far = vertices.join(spread(base), "mesh_id").groupBy("mesh_id").agg(steps(from_first).alias("k1"), steps(from_mean).alias("k2"), F.max_by(place, F.struct(from_first, -F.col("n"))).alias("far"), F.max(from_first).alias("reach"), _form(vertices, F.col("p0")).alias("form"))
    line = base.join(spread(far), "mesh_id")
    arm = _minus(_of(at), _of(F.col("p0")))
    off = _length(_cross(_unit(_minus(_of(F.col("far")), _of(F.col("p0")))), arm))
    side = vertices.join(spread(line.select("mesh_id", "p0", "far")), "mesh_id").groupBy("mesh_id").agg(F.max_by(place, F.struct(off, -F.col("n"))).alias("side"), F.max(off).alias("width"))
    framed = ~F.col("bare") & (F.col("reach") > TOLERANCE) & (F.coalesce("width", F.lit(0.0)) > TOLERANCE)
    return line.join(spread(side), "mesh_id").select("mesh_id", F.struct("size", "colour", "k1", "k2").alias("key"), "form", "p0", "centre", "far", "side", framed.alias("framed"))


def _matches(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Of pairs of an open mesh and a head (first, rank, shares, first_p0, first_far, first_side, first_centre, p0) those that match in
    all vertices, with the rotation (null: none)."""
    n = F.col("v.n")
    place = F.struct("v.x", "v.y", "v.z")
    asked = pairs.select("mesh_id", "first", F.col("first_far.n").alias("n1"), F.col("first_side.n").alias("n2"))
    corners = asked.alias("p").join(spread(vertices.alias("v")), "mesh_id").where((n == F.col("n1")) | (n == F.col("n2"))).groupBy("mesh_id", "first").agg(F.max(F.when(n == F.col("n1"), place)).alias("q1"), F.max(F.when(n == F.col("n2"), place)).alias("q2"))
    framed = with_frame(pairs.join(spread(corners), ["mesh_id", "first"]), "own_", F.col("p0"), F.col("q1"), F.col("q2"))
    framed = with_frame(framed, "other_", F.col("first_p0"), F.col("first_far"), F.col("first_side"))
    placed = settled(framed.withColumn("rotation", turn(F.col("other_"), F.col("own_"))).drop("own_", "other_", "q1", "q2"))
    # a head's vertices, a copy a share
    share = F.pmod(F.xxhash64("mesh_id"), F.col("shares"))
    heads = pairs.select("first", "shares").distinct().join(spread(vertices.withColumnsRenamed({"mesh_id": "first", "x": "hx", "y": "hy", "z": "hz", **{f"n{a}": f"hn{a}" for a in "xyz"}})), "first")
    heads = heads.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares", "colour")
    rows = placed.select("mesh_id", "first", "rotation", "p0", "first_p0", share.alias("share")).join(spread(vertices), "mesh_id").join(spread(heads), ["first", "share", "n"])
    there = _minus([F.col(a) for a in "xyz"], _of(F.col("p0")))
    here = _minus([F.col("h" + a) for a in "xyz"], _of(F.col("first_p0")))
    beside = lambda p, q: F.greatest(*[F.abs(d) for d in _minus(p, q)])
    worst = {"moved": beside(there, here), "turned": beside(there, turned(F.col("rotation"), here))}
    if {"nx", "ny", "nz"} <= set(vertices.columns):
        normal, of = [F.col(f"n{a}") for a in "xyz"], [F.col(f"hn{a}") for a in "xyz"]
        # one measure for both limits
        scale = TOLERANCE / NORMAL_TOLERANCE
        worst = {"moved": F.greatest(worst["moved"], scale * beside(normal, of)), "turned": F.greatest(worst["turned"], scale * beside(normal, turned(F.col("rotation"), of)))}
    got = rows.groupBy("mesh_id", "first").agg(*[F.max(c).alias(k) for k, c in worst.items()], F.count("*").alias("held"))
    fits = {k: F.coalesce(F.col(k), F.lit(float("inf"))) <= TOLERANCE for k in worst}
    return placed.join(spread(got), ["mesh_id", "first"]).where((F.col("held") == F.col("key.size")) & (fits["moved"] | fits["turned"])).withColumn("rotation", F.when(~fits["moved"], F.col("rotation")))


def repeated_geometry(vertices: DataFrame) -> DataFrame:
    """A row a mesh: mesh_id, ``first`` (the mesh that it repeats, or its own id), ``rotation`` (quaternion) and ``move``: a vertex p of
    ``first`` is at move + rotation * (p - the centre of first's box).

    ``vertices``: mesh_id, n (from 0, the corners of triangles in their order, three a triangle), x, y, z; if there, colour, which
    must agree, and nx, ny, nz, which turn along. Meshes are ordered by mesh_id.
    """
    vertices = vertices.where("mesh_id is not null and n is not null")
    meshes = written(_described(vertices).select("mesh_id", "key", "form", "p0", "centre", "framed"))
    still = F.struct(*[F.lit(v).alias(a) for a, v in zip("xyzw", (0.0, 0.0, 0.0, 1.0))])
    bare = meshes.where(~F.col("framed")).select("mesh_id", F.lit(None).cast(meshes.schema["mesh_id"].dataType).alias("first"), still.alias("rotation"), F.col("centre").alias("move"))
    forms = written(meshes.where("framed").groupBy("key", "form").agg(F.min("mesh_id").alias("mesh_id")))
    named = [r["mesh_id"] for r in forms.select("mesh_id").limit(MOST_NAMED + 1).collect()]
    known = F.col("mesh_id").isin(named)
    vertices = vertices.where(known) if len(named) <= MOST_NAMED else written(vertices.join(spread(forms.select("mesh_id")), "mesh_id", "left_semi"))
    earliest = _described(vertices).drop("key", "form").join(spread(forms), "mesh_id")
    earliest = settled(earliest.join(spread(_sound(vertices, earliest)), "mesh_id").where("sound").drop("sound", "framed"))
    like = _repeated(earliest, vertices, still)
    like = settled(forms.join(spread(like), "mesh_id").drop("mesh_id"))
    # what matches nothing is its own first
    own = F.col("first").isNull() | (F.col("first") == F.col("mesh_id"))
    away = F.struct(*[(p + d).alias(a) for a, p, d in zip("xyz", _of(F.col("p0")), _of(F.col("away")))])
    all_ = meshes.where("framed").drop("framed").join(spread(like), ["key", "form"], "left")
    all_ = all_.select("mesh_id", F.coalesce("first", "mesh_id").alias("first"), F.coalesce("rotation", still).alias("rotation"), F.when(own, F.col("centre")).otherwise(away).alias("move"))
    return bare.unionByName(all_)


def _repeated(open_: DataFrame, vertices: DataFrame, still: Column) -> DataFrame:
    """Of described meshes: mesh_id, first, rotation, and ``away``, where the centre of first's box lies as seen from the mesh's first place."""
    found, most = [], 1
    seen = lambda turn, centre, p0: F.struct(*[d.alias(a) for a, d in zip("xyz", turned(turn, _minus(_of(centre), _of(p0))))])
    upright = F.array(*[F.lit(float(i == j)) for i in range(3) for j in range(3)])
    while not open_.isEmpty():
        order = F.row_number().over(Window.partitionBy("key").orderBy("mesh_id"))
        sizes = open_.groupBy("key").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
        heads = settled(open_.withColumn("rank", order).where(F.col("rank") <= most).join(spread(sizes), "key"))
        as_head = heads.select("key", "rank", "shares", F.col("mesh_id").alias("first"), *[F.col(c).alias(f"first_{c}") for c in ("p0", "far", "side", "centre")])
        pairs = open_.drop("far", "side").join(spread(as_head), "key").where(F.col("mesh_id") > F.col("first"))
        matched = settled(_matches(pairs, vertices))
        # heads in their order: one that matches an earlier true head is none
        earlier = matched.join(spread(heads.select("mesh_id")), "mesh_id", "left_semi").groupBy("mesh_id").agg(F.collect_list("rank").alias("like"))
        ranked = heads.join(spread(earlier), "mesh_id", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("like", F.array().cast("array<int>")).alias("like"), "mesh_id"))).alias("all"))
        true = F.aggregate("all", F.array().cast("array<int>"), lambda got, h: F.when(F.arrays_overlap(got, h["like"]), got).otherwise(F.array_append(got, h["rank"])))
        firsts = settled(ranked.withColumn("true", true).select(F.explode(F.filter("all", lambda h: F.array_contains("true", h["rank"]))).alias("h")).select(F.col("h.mesh_id").alias("first")))
        best = matched.join(spread(firsts), "first", "left_semi").groupBy("mesh_id").agg(F.min_by(F.struct("first", "rotation", "p0", "first_p0", "first_centre"), "rank").alias("m"))
        best = with_quaternion(best.withColumn("turn", F.coalesce(F.col("m.rotation"), upright)), "spin", "turn")
        away = seen(F.col("turn"), F.col("m.first_centre"), F.col("m.first_p0"))
        copies = settled(best.select("mesh_id", "m.first", F.when(F.col("m.rotation").isNull(), still).otherwise(F.col("spin")).alias("rotation"), away.alias("away")))
        own = open_.join(spread(firsts.select(F.col("first").alias("mesh_id"))), "mesh_id", "left_semi")
        found += [copies, own.select("mesh_id", F.col("mesh_id").alias("first"), still.alias("rotation"), seen(upright, F.col("centre"), F.col("p0")).alias("away"))]
        open_ = settled(open_.join(spread(copies.select("mesh_id").union(firsts)), "mesh_id", "left_anti"))
        most = min(2 * most, MOST_HEADS)
    return reduce(DataFrame.unionByName, found) if found else open_.select("mesh_id", F.col("mesh_id").alias("first"), still.alias("rotation"), seen(upright, F.col("centre"), F.col("p0")).alias("away"))
