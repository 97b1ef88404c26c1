"""Box tables, indexes and results to files and databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthobox.functions.boxes import axes
from orthobox.operators.index import SpatialIndex


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """Result rows, one JSON object per line."""
    df.write.json(path)


def rounded(c: Column, digits: int) -> Column:
    """The number to so many digits as SQL engines in binary arithmetic do it: scaled, rounded, scaled back. F.round goes by the
    decimal digits that are printed, which differs where the scaled number falls short of a half: 65.0255 is 65.025 here."""
    scale = F.lit(10.0**digits)
    return F.round(c * scale) / scale


def polygon(d: int, srid: int | None = None) -> Column:
    """A box on two axes as the text of a closed ring, counter-clockwise from its lower corner; with an srid in front of it."""
    if d != 2:
        raise ValueError("polygons need two axes")
    corners = [("min_0", "min_1"), ("max_0", "min_1"), ("max_0", "max_1"), ("min_0", "max_1"), ("min_0", "min_1")]
    ring = F.concat_ws(", ", *[F.concat_ws(" ", *[F.col(c).cast("double").cast("string") for c in corner]) for corner in corners])
    return F.concat(F.lit("" if srid is None else f"SRID={srid};"), F.lit("POLYGON(("), ring, F.lit("))"))


def export_tables(index: SpatialIndex, tree_id: int = 1, key: str = "id", srid: int | None = None) -> dict[str, DataFrame]:
    """The index as three tables for a database: tree, tree_node (box, level, parent, leaf) and tree_entry (box, node).

    With an srid (two axes) a box is one column, bbox, as create_tables_sql makes it; else its corners are columns.
    """
    d = axes(index.nodes)
    box = [c for i in range(d) for c in (f"min_{i}", f"max_{i}")] if srid is None else [polygon(d, srid).alias("bbox")]
    tree = index.nodes.sparkSession.createDataFrame([(tree_id,)], "id int")
    nodes = index.nodes.select(F.lit(tree_id).alias("tree_id"), F.col("node_id").alias("id"), "level", "parent_id", F.col("is_leaf").alias("leaf"), *box)
    entries = index.entries.select(F.lit(tree_id).alias("tree_id"), F.col("node_id").alias("parent_node_id"), F.col(key).alias("data"), *box)
    return {"tree": tree, "tree_node": nodes, "tree_entry": entries}


def save_index(index: SpatialIndex, path: str, tree_id: int = 1, key: str = "id") -> None:
    """The tables as Parquet, entries clustered by leaf so that their statistics prune."""
    for name, df in export_tables(SpatialIndex(index.nodes, index.by_leaf()), tree_id, key).items():
        df.write.parquet(f"{path}/{name}")


def save_jdbc(index: SpatialIndex, url: str, properties: dict, schema: str = "public", tree_id: int = 1, key: str = "id", mode: str = "append", srid: int | None = None) -> None:
    """The tables into a database over JDBC; the driver's jar has to be on Spark's class path. With an srid boxes travel as
    text, which the database is left to read as polygons."""
    properties = properties if srid is None else {"stringtype": "unspecified", **properties}
    for name, df in export_tables(index, tree_id, key, srid).items():
        df.write.jdbc(url, f"{schema}.{name}", mode=mode, properties=properties)


def create_tables_sql(schema: str = "public", d: int = 2, datatype: str = "BIGINT", srid: int | None = None) -> list[str]:
    """Statements that make the three tables; with an srid (two axes) boxes are polygons under a spatial index."""
    if srid is not None and d != 2:
        raise ValueError("polygons need two axes")
    box = f"bbox geometry(Polygon, {srid}) NOT NULL" if srid is not None else ", ".join(f"min_{i} DOUBLE PRECISION NOT NULL, max_{i} DOUBLE PRECISION NOT NULL" for i in range(d))
    out = [
        f"CREATE TABLE {schema}.tree (id INT PRIMARY KEY)",
        f"CREATE TABLE {schema}.tree_node (tree_id INT REFERENCES {schema}.tree (id), id TEXT, level INT NOT NULL, parent_id TEXT, leaf BOOLEAN NOT NULL, {box}, PRIMARY KEY (tree_id, id))",
        f"CREATE TABLE {schema}.tree_entry (tree_id INT, parent_node_id TEXT, data {datatype}, {box}, FOREIGN KEY (tree_id, parent_node_id) REFERENCES {schema}.tree_node (tree_id, id))",
    ]
    return out + [f"CREATE INDEX {t}_bbox ON {schema}.{t} USING GIST (bbox)" for t in ("tree_node", "tree_entry") if srid is not None]


def clear_tables_sql(schema: str = "public") -> list[str]:
    return [f"TRUNCATE TABLE {schema}.tree_entry, {schema}.tree_node, {schema}.tree"]


def drop_tables_sql(schema: str = "public") -> list[str]:
    return [f"DROP TABLE IF EXISTS {schema}.{t}" for t in ("tree_entry", "tree_node", "tree")]


def diagram(index: SpatialIndex) -> DataFrame:
    """line, n: a DOT graph of the nodes, one record each, and the links to their children."""
    d = axes(index.nodes)
    box = F.concat_ws(", ", *[F.format_string("[%s, %s]", rounded(F.col(f"min_{i}"), 3).cast("string"), rounded(F.col(f"max_{i}"), 3).cast("string")) for i in range(d)])
    nodes = index.nodes.select(F.concat(F.lit('  "'), "node_id", F.lit('" [shape=record, label="{'), "node_id", F.lit("|"), box, F.lit('}"];')).alias("line"), F.lit(1).alias("n"))
    links = index.nodes.filter("parent_id is not null").select(F.concat(F.lit('  "'), "parent_id", F.lit('" -> "'), "node_id", F.lit('";')).alias("line"), F.lit(2).alias("n"))
    ends = index.nodes.sparkSession.createDataFrame([("digraph {", 0), ("}", 3)], "line string, n int")
    return ends.unionByName(nodes).unionByName(links).orderBy("n", "line")


def plot(index: SpatialIndex, path: str, most: int = 100_000) -> None:
    """Leaf entries and node boxes of a two-axis index as a picture; needs matplotlib. At most `most` of each are drawn, nodes
    from the root down."""
    try:
        from matplotlib import pyplot
        from matplotlib.patches import Rectangle
    except ImportError as e:
        raise RuntimeError("plot needs matplotlib") from e
    figure, ax = pyplot.subplots()
    for df, colour in ((index.entries.limit(most), "tab:blue"), (index.nodes.orderBy("level", "node_id").limit(most), "tab:red")):
        for r in df.select("min_0", "min_1", "max_0", "max_1").toLocalIterator():
            ax.add_patch(Rectangle((r[0], r[1]), r[2] - r[0], r[3] - r[1], fill=False, edgecolor=colour))
    ax.autoscale_view()
    ax.margins(0.1)
    figure.savefig(path)
    pyplot.close(figure)
