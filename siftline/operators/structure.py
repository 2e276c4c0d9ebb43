"""Checks on atom records of structure files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_models(lines: DataFrame, file: str, order: str, text: str = "value") -> DataFrame:
    """Adds ``model`` to the lines of files: the name in the last MODEL record so far, its place where it has none, and 1
    before the first."""
    name = F.regexp_extract(text, r"^\s*\S+\s+(\S+)", 1)
    starts = F.when(F.trim(F.substring(text, 1, 6)) == "MODEL", F.when(name != "", name).otherwise(F.col(order).cast("string")))
    upto = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("model", F.coalesce(F.last(starts, ignorenulls=True).over(upto), F.lit("1")))


def atoms(lines: DataFrame, text: str = "value") -> DataFrame:
    """Atom records of a structure file's lines, by fixed columns, else by blanks where a number there doesn't parse.

    A record by blanks is type, serial, atom, residue, chain, number, x, y, z and, if there, occupancy and B factor. What
    fits neither form has ``malformed`` set and no values. An empty occupancy or B factor is null.
    """
    part = lambda a, n: F.trim(F.substring(text, a, n))
    number = lambda c: c.try_cast("double")
    names = ("x", "y", "z", "occupancy", "b_factor")
    columns = [part(a, n) for a, n in ((31, 8), (39, 8), (47, 8), (55, 6), (61, 6))]
    fixed_ok = F.lit(True)
    for name, c in zip(names, columns):
        fixed_ok = fixed_ok & (number(c).isNotNull() | (c == "" if name in ("occupancy", "b_factor") else F.lit(False)))
    fixed = F.struct(part(7, 5).alias("serial"), F.concat_ws("|", part(1, 6), part(22, 1), part(23, 4), part(27, 1), part(18, 3), part(13, 4), part(17, 1)).alias("identity"), *(number(F.nullif(c, F.lit(""))).alias(n) for n, c in zip(names, columns)))
    word = lambda k: F.get("_parts", F.lit(k))
    loose_ok = (F.size("_parts") >= 9) & number(word(6)).isNotNull() & number(word(7)).isNotNull() & number(word(8)).isNotNull()
    for k in (9, 10):
        loose_ok = loose_ok & (word(k).isNull() | number(word(k)).isNotNull())
    loose = F.struct(word(1).alias("serial"), F.concat_ws("|", word(0), word(4), word(5), F.lit(""), word(3), word(2), F.lit("")).alias("identity"), *(number(word(k)).alias(n) for k, n in enumerate(names, 6)))
    rows = lines.where(F.trim(F.substring(text, 1, 6)).isin("ATOM", "HETATM")).withColumn("_parts", F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    rows = rows.withColumn("_atom", F.when(fixed_ok, fixed).when(loose_ok, loose))
    return rows.select(*lines.columns, F.col("_atom").isNull().alias("malformed"), "_atom.*")


def malformed_findings(atoms_: DataFrame, file: str) -> DataFrame:
    """Files with records that couldn't be read: five or more, or a twentieth of all, are medium."""
    a = atoms_.groupBy(file).agg(F.count_if("malformed").alias("records"), F.count("*").alias("all")).where("records > 0")
    share = F.col("records") / F.col("all")
    return a.select(file, F.lit("pdb_malformed_atom_records").alias("test"), "records", F.bround(share, 4).alias("ratio"), F.when((F.col("records") >= 5) | (share >= 0.05), "medium").otherwise("low").alias("severity"))


def _groups(atoms_: DataFrame, file: str, keys: list, extra: list, test: str):
    return atoms_.groupBy(file, *keys).agg(F.count("*").alias("n"), *extra).where("n > 1").withColumn("test", F.lit(test))


def duplicate_findings(atoms_: DataFrame, file: str) -> DataFrame:
    """Repeated identities, serials and coordinates of each file, or of each ``model`` of it, with severities."""
    model = ["model"] if "model" in atoms_.columns else []
    atoms_ = atoms_.where("identity is not null")
    ident = _groups(atoms_, file, [*model, "identity"], [], "pdb_duplicate_atom_identity").groupBy(file, "test").agg(F.sum("n").alias("records"), F.count("*").alias("groups"))
    ident = ident.withColumn("severity", F.when((F.col("records") >= 10) | (F.col("groups") >= 5), "high").otherwise("medium"))
    serial = _groups(atoms_.where("serial <> ''"), file, [*model, "serial"], [], "pdb_duplicate_atom_serial").groupBy(file, "test").agg(F.sum("n").alias("records"), F.count("*").alias("groups"))
    serial = serial.withColumn("severity", F.when(F.col("records") >= 10, "medium").otherwise("low"))
    at = [F.bround(c, 3).alias(c) for c in "xyz"]
    coord = _groups(atoms_.where("x is not null and y is not null and z is not null"), file, [*model, *at], [F.count_distinct("identity").alias("kinds")], "pdb_duplicate_coordinates").where("kinds >= 2")
    coord = coord.groupBy(file, "test").agg(F.sum("n").alias("records"), F.count("*").alias("groups"))
    coord = coord.withColumn("severity", F.when((F.col("records") >= 20) | (F.col("groups") >= 10), "high").otherwise("medium"))
    return ident.unionByName(serial).unionByName(coord)


def range_findings(atoms_: DataFrame, file: str) -> DataFrame:
    """Impossible occupancies, negative B factors and zero coordinates of the records that could be read."""
    atoms_ = atoms_.where("identity is not null")
    near = lambda c: F.abs(c) < 0.0005
    a = atoms_.groupBy(file).agg(
        F.count("*").alias("n"),
        F.count_if((F.col("occupancy") < 0) | (F.col("occupancy") > 1)).alias("occupancy"),
        F.count_if(F.col("b_factor") < 0).alias("b_factor"),
        F.count_if(near("x") & near("y") & near("z")).alias("zero"),
    )
    rows = F.array(
        F.struct(F.lit("pdb_invalid_occupancy").alias("test"), F.col("occupancy").alias("records"), F.when(F.col("occupancy") >= 20, "high").when(F.col("occupancy") > 0, "medium").alias("severity")),
        F.struct(F.lit("pdb_negative_bfactor").alias("test"), F.col("b_factor").alias("records"), F.when(F.col("b_factor") >= 10, "medium").when(F.col("b_factor") > 0, "low").alias("severity")),
        F.struct(F.lit("pdb_zero_coordinates").alias("test"), F.col("zero").alias("records"), F.when((F.col("zero") >= 10) | ((F.col("zero") >= 3) & (F.col("zero") / F.col("n") >= 0.01)), "high").when(F.col("zero") >= 3, "medium").alias("severity")),
    )
    return a.select(file, F.inline(rows)).where("severity is not null")
