"""Whitening of embeddings by an exact characteristic polynomial.

Entries become integers, x = floor(1024 c) + ``OFFSET``. For n vectors with sums S, the integer matrix M = n * (sum of x x') - S S' is
n^2 times their covariance, and does not change with the offset, so it is built from y = floor(1024 c).

1. Sums and products are added up per task in exact integers and leave it as limbs of 40 bits, one row per entry.
2. The characteristic polynomial of M is found modulo primes below 2^31: similarity steps bring M to Hessenberg form, a recurrence
   over its leading blocks gives the polynomial. Primes are dealt to tasks; their product exceeds twice the bound
   (1 + trace / d)^d of all coefficients, so Chinese remaindering gives the polynomial itself.
3. All roots are real and none is negative, so the sign changes of the polynomial shifted to a point count the roots above it.
   Intervals that hold several roots are halved by that count, single roots by the polynomial's sign, to ``ROOT_BITS`` relative bits.
   What is not apart by then is one root of that multiplicity.
4. Components span the null space of M - root: inverse iteration in decimals of ``DIGITS`` digits, with as many start vectors
   as the root has multiplicity, made orthonormal. Their largest entry (the first of such) is positive.
5. Rows are projected where they lie; the covariance of what came out is measured over all of them.

Defined results: vectors that are null or hold nulls or non-finite entries are dropped. Vectors of different lengths are spaces of
their own, each with its own n, sums and components. Components without variance do not exist (there are as many as the exact
rank, up to ``components``), so equal vectors, a single vector and empty vectors give no rows; an empty table gives an empty one.
Repeated rows and rows with null ids count and are returned each. Equal eigenvalues share a space, any orthonormal basis of which is
right; the one returned depends on the data alone. Entries of any finite size are exact. ``deviation`` is null where 38 digits do not hold
it. Other columns are ignored, whatever their names; ids keep their type. Work and memory of step 2 to 4 depend on the length d only,
about d^4, and are meant for lengths up to a few hundred.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelflens.session import materialize

OFFSET = 100_000
SCALE = 1024
COMPONENTS = 8
LIMB = 40
WINDOW = 512  # numbers searched for primes by one row of step 2
ROOT_BITS = 256
DIGITS = 120
BLOCK_ROWS = 1 << 12
SMALL = 1 << 20  # entries up to here: products of a block's rows are exact in doubles
HELD = 1 << 22  # entries of sums a task holds, numbers of components in one broadcast


def _integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 c) of finite doubles: doubles while all are small, Python integers otherwise."""
    with np.errstate(over="ignore"):
        y = np.floor(values * SCALE)
    if y.size == 0 or np.abs(y).max() <= SMALL:
        return y
    whole = [int(c) * SCALE if abs(c) >= 2 ** 53 else math.floor(c * SCALE) for c in values.ravel().tolist()]
    exact = np.empty(len(whole), object)
    exact[:] = whole
    return exact.reshape(values.shape)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for every length of vectors in a batch, ``BLOCK_ROWS`` rows at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths())
    values = column.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        for lo in range(0, len(rows), BLOCK_ROWS):
            part = rows[lo:lo + BLOCK_ROWS]
            yield part, values[starts[part][:, None] + np.arange(d)]


def _exact(matrix: np.ndarray) -> np.ndarray:
    """An array of Python integers."""
    return matrix if matrix.dtype == object else matrix.astype(np.int64).astype(object)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    place = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield place, value & (1 << LIMB) - 1
        value >>= LIMB
        place += 1
    yield place, value


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, i, j, place, value: limbs of the counts (i = j = -1), the sums (i = -1) and the products with i <= j."""
    held: dict[int, list] = {}

    def rows() -> pa.RecordBatch:
        out = []
        for d, (n, sums, products) in held.items():
            entries = [(-1, -1, n), *((-1, j, v) for j, v in enumerate(sums)), *((i, j, products[i, j]) for i in range(d) for j in range(i, d))]
            out += [(d, i, j, place, limb) for i, j, value in entries for place, limb in _limbs(int(value))]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] * 4 + [pa.int64()])],
                                          names=["dim", "i", "j", "place", "value"])

    for batch in batches:
        for part, values in _by_length(batch.column(0)):
            d = values.shape[1]
            if d not in held:
                if sum(k * k for k in held) + d * d > HELD and held:
                    yield rows()
                held[d] = [0, np.zeros(d, object), np.zeros((d, d), object)]
            y = _integers(values)
            one = held[d]
            one[0] += len(part)
            one[1] += _exact(y.sum(axis=0))
            one[2] += _exact(y.T @ y)
    if held:
        yield rows()


def _primes(window: int) -> list[int]:
    """The primes of the window-th stretch of ``WINDOW`` numbers below 2^31."""
    top = (1 << 31) - window * WINDOW
    numbers = np.arange(top - WINDOW, top)
    small = np.ones(46_342, bool)
    small[:2] = False
    for k in range(2, 216):
        if small[k]:
            small[k * k::k] = False
    left = np.ones(WINDOW, bool)
    for q in np.flatnonzero(small).tolist():
        left[-int(numbers[0]) % q::q] = False
    return numbers[left].tolist()


def _gather(key: tuple, limbs: pa.Table) -> pa.Table:
    """One row per length: n, the sums and the entries of M with i <= j as texts of integers, and the windows of primes needed."""
    d = key[0].as_py()
    found: dict[tuple[int, int], int] = {}
    for i, j, place, value in zip(*[limbs[c].to_pylist() for c in ("i", "j", "place", "value")]):
        found[i, j] = found.get((i, j), 0) + (value << LIMB * place)
    n, sums = found[-1, -1], [found[-1, j] for j in range(d)]
    scatter = [n * found[i, j] - sums[i] * sums[j] for i in range(d) for j in range(i, d)]
    trace = sum(n * found[i, i] - sums[i] ** 2 for i in range(d))
    bound, product, windows = 2 * (1 + -(-trace // max(1, d))) ** d, 1, 0
    while product <= bound:
        product *= math.prod(_primes(windows))
        windows += 1
    return pa.table({"dim": pa.array([d], pa.int32()), "n": [str(n)], "sums": [list(map(str, sums))], "scatter": [list(map(str, scatter))],
                     "windows": pa.array([windows], pa.int32())}, schema=pa.schema([
                         ("dim", pa.int32()), ("n", pa.string()), ("sums", pa.list_(pa.string())), ("scatter", pa.list_(pa.string())),
                         ("windows", pa.int32())]))


def _square(d: int, entries: list[str]) -> np.ndarray:
    matrix = np.zeros((d, d), object)
    matrix[np.triu_indices(d)] = list(map(int, entries))
    return np.where(np.tri(d, k=-1, dtype=bool), matrix.T, matrix) if d else matrix


def hessenberg_polynomials(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients (lowest first) of det(x - matrix) modulo each prime, for a matrix of Python integers."""
    d = len(matrix)
    p = np.array(primes, np.int64)[:, None, None]
    h = np.stack([(matrix % q).astype(np.int64) for q in primes])
    for m in range(1, d - 1):
        for k in np.flatnonzero(h[:, m, m - 1] == 0):  # another row becomes the pivot
            other = np.flatnonzero(h[k, m:, m - 1])
            if len(other):
                i = m + other[0]
                h[k, [m, i]] = h[k, [i, m]]
                h[k][:, [m, i]] = h[k][:, [i, m]]
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(h[:, m, m - 1], primes)], np.int64)
        u = h[:, m + 1:, m - 1] * inverse[:, None] % p[:, 0]
        h[:, m + 1:] = (h[:, m + 1:] - u[:, :, None] * h[:, m][:, None] % p) % p
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1:] * u[:, None] % p).sum(axis=2)) % p[:, 0]
    polynomials = np.zeros((d + 1, len(primes), d + 1), np.int64)
    polynomials[0, :, 0] = 1
    q = p[:, 0]
    for k in range(1, d + 1):
        one = -(h[:, k - 1, k - 1][:, None] * polynomials[k - 1]) % q
        one[:, 1:] += polynomials[k - 1][:, :-1]
        below = np.ones(len(primes), np.int64)
        for i in range(1, k):
            below = below * h[:, k - i, k - i - 1] % q[:, 0]
            one = (one - (h[:, k - i - 1, k - 1] * below % q[:, 0])[:, None] * polynomials[k - i - 1] % q) % q
        polynomials[k] = one % q
    return polynomials[d]


def _residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, scatter, window in zip(*[c.to_pylist() for c in batch.columns]):
            primes = _primes(window)
            found = hessenberg_polynomials(_square(d, scatter), primes)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(primes), pa.int32()), pa.array(primes, pa.int64()),
                                              pa.array(found.tolist(), pa.list_(pa.int64()))], names=["dim", "prime", "residues"])


def remainders(primes: list[int], residues: list[list[int]]) -> list[int]:
    """The integers, of either sign, that leave these residues."""
    product = math.prod(primes)
    parts = [product // q * pow(product // q, -1, q) for q in primes]
    found = [sum(part * r for part, r in zip(parts, column)) % product for column in zip(*residues)]
    return [v - product if 2 * v > product else v for v in found]


def roots_above(polynomial: list[int], at: int, scale: int) -> int:
    """How many roots of a polynomial with only real roots lie above at / 2^scale: sign changes after a shift to there."""
    d = len(polynomial) - 1
    c = [v << scale * (d - i) for i, v in enumerate(polynomial)]
    for lowest in range(d):
        for i in range(d - 1, lowest - 1, -1):
            c[i] += c[i + 1] * at
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(polynomial: list[int], at: int, scale: int) -> int:
    value, d = 0, len(polynomial) - 1
    for i in range(d, -1, -1):
        value = value * at + (polynomial[i] << scale * (d - i))
    return (value > 0) - (value < 0)


def top_roots(polynomial: list[int], top: int, wanted: int) -> list[tuple[int, int, int]]:
    """The greatest positive roots (root * 2^scale, scale, multiplicity), falling; none lies above ``top``."""
    hi = 1 << max(1, top).bit_length()
    found: list[tuple[int, int, int]] = []
    stack = [(0, hi, 0, roots_above(polynomial, 0, 0), roots_above(polynomial, hi, 0))]
    while stack and sum(m for *_, m in found) < wanted:
        lo, hi, scale, above_lo, above_hi = stack.pop()
        inside = above_lo - above_hi
        if inside == 1:
            sign = _sign(polynomial, hi, scale)
            while sign and (hi - lo) << ROOT_BITS > hi:
                lo, hi, scale, middle = 2 * lo, 2 * hi, scale + 1, lo + hi
                here = _sign(polynomial, middle, scale)
                if not here:
                    lo = hi = middle
                elif here == sign:
                    hi = middle
                else:
                    lo = middle
            found.append((hi, scale, 1))
        elif inside and (hi - lo) << ROOT_BITS <= hi:
            found.append((hi, scale, inside))
        elif inside:
            middle = lo + hi
            above = roots_above(polynomial, middle, scale + 1)
            stack += [(2 * lo, middle, scale + 1, above_lo, above), (middle, 2 * hi, scale + 1, above, above_hi)]
    return found


def null_space(matrix: np.ndarray, root: Decimal, size: int) -> list[np.ndarray]:
    """``size`` orthonormal vectors that ``matrix`` - ``root`` all but annihilates, by inverse iteration."""
    d = len(matrix)
    lower = matrix.copy()
    lower[np.diag_indices(d)] -= root
    tiny = (abs(root) + 1).scaleb(-DIGITS + 10)
    order = np.arange(d)
    for k in range(d):
        best = k + max(range(d - k), key=lambda i: abs(lower[k + i, k]))
        lower[[k, best]], order[[k, best]] = lower[[best, k]], order[[best, k]]
        if abs(lower[k, k]) < tiny:
            lower[k, k] = tiny
        lower[k + 1:, k] = lower[k + 1:, k] / lower[k, k]
        lower[k + 1:, k + 1:] -= np.outer(lower[k + 1:, k], lower[k, k + 1:])

    def solve(right: np.ndarray) -> np.ndarray:
        x = right[order]
        for k in range(1, d):
            x[k] -= lower[k, :k] @ x[:k]
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] - lower[k, k + 1:] @ x[k + 1:] if k + 1 < d else x[k]) / lower[k, k]
        return x

    # fixed start vectors without structure of their own
    starts = [np.array([Decimal((i * 7919 + s * 104_729 + 12_345) * 48_271 % 2_147_483_647 - 1_073_741_823) / 2 ** 30 for i in range(d)])
              for s in range(size)]
    for _ in range(3):
        made: list[np.ndarray] = []
        for x in starts:
            x = solve(x)
            x = x / max(abs(v) for v in x)
            for _ in range(2):
                for other in made:
                    x = x - other * (x @ other)
                x = x / (x @ x).sqrt()
            made.append(x)
        starts = made
    return starts


def principal(matrix: np.ndarray, polynomial: list[int], wanted: int) -> list[tuple[Decimal, np.ndarray]]:
    """The greatest positive eigenvalues of an integer matrix with a unit eigenvector each, falling."""
    trace = int(sum(matrix[i, i] for i in range(len(matrix))))
    found = []
    with decimal.localcontext(decimal.Context(prec=DIGITS, Emin=decimal.MIN_EMIN, Emax=decimal.MAX_EMAX)):
        exact = np.array([[Decimal(v) for v in row] for row in matrix.tolist()], object).reshape(matrix.shape)
        for at, scale, size in top_roots(polynomial, trace, wanted):
            root = Decimal(at) / Decimal(2) ** scale
            for x in null_space(exact, root, min(size, wanted - len(found))):
                large = max(range(len(x)), key=lambda i: (abs(x[i]).quantize(Decimal("1e-30")), -i))
                found.append((root, -x if x[large] < 0 else x))
    return found


_MODEL = T.StructType([
    T.StructField("dim", T.IntegerType()), T.StructField("n", T.StringType()), T.StructField("sums", T.ArrayType(T.StringType())),
    T.StructField("eigenvalues", T.ArrayType(T.DoubleType())), T.StructField("explained", T.ArrayType(T.DoubleType())),
    T.StructField("components", T.ArrayType(T.ArrayType(T.DoubleType())))])


def _solver(wanted: int):
    def solve(sums: pa.Table, residues: pa.Table) -> pa.Table:
        d, n = sums["dim"][0].as_py(), int(sums["n"][0].as_py())
        matrix = _square(d, sums["scatter"][0].as_py())
        found = sorted(zip(residues["prime"].to_pylist(), residues["residues"].to_pylist()))
        polynomial = remainders(*map(list, zip(*found)))
        trace = int(sum(matrix[i, i] for i in range(d)))
        pairs = principal(matrix, polynomial, wanted)
        return pa.table({
            "dim": pa.array([d], pa.int32()), "n": pa.array([str(n)]), "sums": pa.array([sums["sums"][0].as_py()], pa.list_(pa.string())),
            "eigenvalues": pa.array([[float(e / n / n) for e, _ in pairs]], pa.list_(pa.float64())),
            "explained": pa.array([[float(e / trace) for e, _ in pairs]], pa.list_(pa.float64())),
            "components": pa.array([[[float(v) for v in x] for _, x in pairs]], pa.list_(pa.list_(pa.float64())))})
    return solve


def _valid(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    entries = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(entries, lambda c: F.coalesce(F.abs(c) < F.lit(math.inf), F.lit(False)))
    return vectors.select(F.col(f"`{id}`").alias("id"), entries.alias("entries")).where(F.col("entries").isNotNull() & finite)


def models(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per length of vectors: dim, n, sums (of floor(1024 c), as texts), eigenvalues, explained, components."""
    limbs = _valid(vectors, id, vector).select("entries").mapInArrow(_sums, "dim int, i int, j int, place int, value long")
    totals = limbs.groupBy("dim", "i", "j", "place").agg(F.sum("value").alias("value"))
    sums = materialize(totals.groupBy("dim").applyInArrow(_gather, "dim int, n string, sums array<string>, scatter array<string>, windows int"), "sums")
    dealt = sums.select("dim", "scatter", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("window"))
    residues = dealt.repartition("dim", "window").mapInArrow(_residues, "dim int, prime long, residues array<long>")
    residues = materialize(residues, "residues")
    return sums.groupBy("dim").cogroup(residues.groupBy("dim")).applyInArrow(_solver(components), _MODEL)


def _projection(known: dict[int, tuple], id_field: T.StructField):
    """(id, dim, whitened, deviation) of vectors whose lengths have a model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known.value
        for batch in batches:
            for part, values in _by_length(batch.column(1)):
                d = values.shape[1]
                n, sums, directions = held[d]
                y = _integers(values)
                whole = _exact(y)
                centred = y - sums / n if y.dtype != object else (whole * n - np.array(sums, object)).astype(float) / n
                whitened = centred.astype(float) @ directions
                if y.dtype == object:
                    squares, met = (whole * whole).sum(axis=1), whole @ sums
                else:
                    small = y.astype(np.int64)
                    squares, met = (small * small).sum(axis=1).astype(object), np.zeros(len(part), object)
                    for place in range(0, max(abs(s) for s in sums).bit_length() + 1, 28):
                        limb = np.array([(abs(s) >> place & (1 << 28) - 1) * (1 if s >= 0 else -1) for s in sums], np.int64)
                        met += (small @ limb).astype(object) * (1 << place)
                total = sum(int(s) ** 2 for s in sums)
                deviation = [n * n * int(q) - 2 * n * int(m) + total for q, m in zip(squares, met)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * directions.shape[1], pa.int32()), pa.array(whitened.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(part)), pa.array(np.full(len(part), d), pa.int32()), lists,
                     pa.array([Decimal(v) if v < 10 ** 38 else None for v in deviation], pa.decimal128(38))], names=["id", "dim", "whitened", "deviation"])

    return run, T.StructType([T.StructField("id", id_field.dataType), T.StructField("dim", T.IntegerType()),
                              T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))])


def _identity_error(components: int) -> F.Column:
    """Largest distance of the entries of a covariance matrix from the identity; lengths of lower rank have fewer entries."""
    at = lambda i: F.get("whitened", F.lit(i))
    errors = [F.abs(F.covar_pop(at(i), at(j)) - float(i == j)) for i in range(components) for j in range(i, components)]
    return F.greatest(*errors, F.lit(0.0))


def _lengths(rows: list, components: int) -> Iterator[list]:
    """Lengths in groups whose components fit one broadcast."""
    part: list = []
    for row in rows:
        if part and (sum(r.dim for r in part) + row.dim) * (components + 1) > HELD:
            yield part
            part = []
        part.append(row)
    if part:
        yield part


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per valid vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark, rows = vectors.sparkSession, _valid(vectors, id, vector)
    id_field = T.StructField(id, vectors.schema[id].dataType)
    fitted = materialize(models(vectors, id, vector, components), "models")
    made = []
    for lengths in _lengths(fitted.where(F.size("eigenvalues") > 0).select("dim").orderBy("dim").collect(), components):
        dims = [r.dim for r in lengths]
        known, about = {}, []
        for m in fitted.where(F.col("dim").isin(dims)).collect():
            n = int(m.n)
            known[m.dim] = (n, np.array(list(map(int, m.sums)), object), np.array(m.components).T / np.sqrt(m.eigenvalues))
            about.append((m.dim, n, m.explained))
        run, schema = _projection(spark.sparkContext.broadcast(known), id_field)
        projected = materialize(rows.where(F.size("entries").isin(dims)).mapInArrow(run, schema), "projected")
        error = projected.groupBy("dim").agg(_identity_error(components).alias("identity_error"))
        about = spark.createDataFrame(about, "dim int, n long, explained array<double>").join(error, "dim")
        one = F.explode(F.transform("whitened", lambda x, i: F.struct((i + 1).cast("int").alias("component"), x.alias("whitened"))))
        # one row per length of this group
        made.append(projected.select("id", "dim", "deviation", one.alias("one")).join(F.broadcast(about), "dim").select(
            F.col("id").alias(id), "one.component", "n", "deviation", "one.whitened", F.get("explained", F.col("one.component") - 1).alias("explained"),
            "identity_error"))
    if not made:
        return spark.createDataFrame([], T.StructType([id_field])).select(
            F.col(f"`{id}`"), *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), (
                "whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    found = made[0]
    for other in made[1:]:
        found = found.unionByName(other)
    return found
