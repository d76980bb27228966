"""Imports, symbols and entities of TypeScript sources, by expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.extract.grammar import NAME, arguments_of, decorators, literal
from plinth.functions.paths import plain_name
from plinth.operators.lookup import resolve

#: `import` or `export`, what it names, and the module; the names are read from the clause afterwards.
STATIC = r"""(?m)^[ \t]*+(?:import|export)\s(?:[^'"`;]*?\sfrom\s*)?['"]([^'"]+)['"]"""
DYNAMIC = r"""\bimport\(\s*['"`]([^'"`]+)['"`]\s*\)"""
CLAUSE = r"""(?m)^[ \t]*+import\b([^'"`;()]*?)\bfrom\s*["']([^"'\n]+)["']"""
#: Endings of files that are imported but hold no code; a query may follow.
ASSETS = "css gif html ico jpeg jpg json less md png sass scss svg txt webp woff woff2".split()
ASSET = rf"(?i)\.(?:{'|'.join(ASSETS)})(?:\?.*)?$"
CANDIDATES = ("", ".ts", ".tsx", "/index.ts", "/index.tsx")


def class_name(path: Column, text: Column) -> Column:
    """The first class that the text exports, else the file's name without `.ts`; null text exports none."""
    found = F.regexp_extract(text, r"\bexport\s++(?:abstract\s++)?class\s++(\w+)", 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"\.ts$", ""))


def imports(files: DataFrame, dynamic: bool = False) -> DataFrame:
    """(src, spec): a row for every import in the text, repeated ones too."""
    found = F.regexp_extract_all("text", F.lit(STATIC), F.lit(1))
    if dynamic:
        found = F.concat(found, F.regexp_extract_all("text", F.lit(DYNAMIC), F.lit(1)))
    return files.select(F.col("path").alias("src"), F.explode(found).alias("spec"))


def clauses(files: DataFrame) -> DataFrame:
    """(src, kind, local, imported, spec): every name that an import binds.

    kind is default, namespace or named; `a as b` binds b. Type-only imports
    count like others.
    """
    pattern = F.lit(CLAUSE)
    both = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("clause"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("spec"))
    rows = files.select(F.col("path").alias("src"), F.explode(both).alias("m")).select("src", F.col("m.spec").alias("spec"), F.regexp_replace(F.trim(F.regexp_replace("m.clause", r"\s+", " ")), "^type (?!,)", "").alias("clause"))
    named = F.filter(F.transform(F.split(F.regexp_extract("clause", r"\{([^}]*)\}", 1), ","), lambda x: F.regexp_replace(F.trim(x), "^type ", "")), lambda x: x != "")
    bare = F.regexp_replace("clause", r"\{[^}]*\}", "")
    star = F.regexp_extract(bare, rf"\* as ({NAME})", 1)
    default = F.regexp_extract(bare, rf"^({NAME}) ?(?:,|$)", 1)
    bound = lambda kind, local, imported: F.struct(F.lit(kind).alias("kind"), local.alias("local"), imported.alias("imported"))
    found = F.concat(
        F.transform(named, lambda x: bound("named", F.element_at(F.split(x, " as "), -1), F.get(F.split(x, " as "), F.lit(0)))),
        F.filter(F.array(bound("default", default, F.lit("default")), bound("namespace", star, F.lit("*"))), lambda x: x["local"] != ""),
    )
    return rows.select("src", "spec", F.explode(found).alias("n")).select("src", "n.kind", "n.local", "n.imported", "spec")


def symbols(files: DataFrame) -> DataFrame:
    """(src, local, imported, spec) of named imports."""
    return clauses(files).where("kind = 'named'").drop("kind")


def edges(files: DataFrame, aliases: Mapping[str, str] | None = None, dynamic: bool = False) -> DataFrame:
    """(src, spec, dst, status) of every import: resolved, external, asset or unresolved.

    aliases map a prefix to a folder; the longest prefix counts.
    """
    spec = F.col("spec")
    for prefix, folder in sorted((aliases or {}).items(), key=lambda x: len(x[0])):
        spec = F.when(F.col("spec").startswith(prefix), F.concat(F.lit(folder), F.substr(F.col("spec"), F.lit(len(prefix) + 1)))).otherwise(spec)
    rows = imports(files, dynamic).withColumnRenamed("spec", "written").withColumn("spec", F.col("written"))
    rows = rows.withColumn("spec", spec)
    local = F.col("spec").startswith(".") | (F.col("spec") != F.col("written"))
    found = resolve(rows, files, CANDIDATES)
    status = F.when(F.col("dst").isNotNull(), "resolved").when(F.col("written").rlike(ASSET), "asset").when(local, "unresolved").otherwise("external")
    return found.select("src", F.col("written").alias("spec"), "dst", status.alias("status"))


CLASS = rf"\bclass\s+({NAME})"
#: The decorators of columns and of relations.
COLUMNS = ("Column", "PrimaryColumn", "PrimaryGeneratedColumn", "CreateDateColumn", "UpdateDateColumn", "DeleteDateColumn", "VersionColumn")
RELATIONS = ("ManyToOne", "OneToMany", "OneToOne", "ManyToMany")


def entities(files: DataFrame) -> DataFrame:
    """(path, cls, tbl, columns, relations) of files that declare an entity.

    columns have name, type as written, nullable (a `?` or a null in the type)
    and pk; relations have name (their kind),
    type (the other class) and via (the member).
    """
    marked = lambda names: rf"@(?:{'|'.join(names)})\b"
    rows = files.where(F.col("text").rlike(r"@Entity\s*\(")).withColumn("members", decorators(F.col("text")))
    columns = F.transform(F.filter("members", lambda m: m["marks"].rlike(marked(COLUMNS))), lambda m: F.struct(m["name"].alias("name"), F.trim(F.regexp_replace(m["type"], r"\s+", " ")).alias("type"), ((m["mark"] == "?") | m["type"].rlike(r"\bnull\b")).alias("nullable"), m["marks"].rlike("@Primary").alias("pk")))
    relations = F.transform(F.filter("members", lambda m: m["marks"].rlike(marked(RELATIONS))), lambda m: F.struct(F.regexp_extract(m["marks"], rf"@({'|'.join(RELATIONS)})\b", 1).alias("name"), F.regexp_extract(m["marks"], rf"=>\s*\(?\s*({NAME})", 1).alias("type"), m["name"].alias("via")))
    return rows.select("path", F.regexp_extract("text", CLASS, 1).alias("cls"), literal(arguments_of(F.col("text"), "Entity"), "name").alias("tbl"), columns.alias("columns"), relations.alias("relations"))


def _named_for(found: DataFrame) -> DataFrame:
    """(cls, column, refers_to): columns named for an entity, as `noteId` for Note; of entities of one name the greatest."""
    columns = found.select("cls", F.explode("columns.name").alias("column")).where(F.col("column").rlike("^.+(Id|_id)$"))
    known = found.select(F.col("cls").alias("refers_to"), plain_name(F.col("cls")).alias("key")).groupBy("key").agg(F.max("refers_to").alias("refers_to"))
    return columns.withColumn("key", plain_name(F.regexp_replace("column", "(Id|_id)$", ""))).join(known, "key").select("cls", "column", "refers_to")


def _declared(found: DataFrame) -> DataFrame:
    return found.select("cls", F.explode("relations").alias("r")).select("cls", F.col("r.name").alias("kind"), F.col("r.type").alias("refers_to"), F.col("r.via").alias("via"))


def implicit_relations(found: DataFrame) -> DataFrame:
    """(cls, column, refers_to) of columns named for an entity that no relation declares."""
    return _named_for(found).join(_declared(found).select("cls", "refers_to").distinct(), ["cls", "refers_to"], "left_anti").select("cls", "column", "refers_to")


def relations(found: DataFrame) -> DataFrame:
    """(cls, refers_to, kind, via, declared): declared relations, with the column of an implicit twin as via, and implicit ones."""
    twins = _named_for(found).groupBy("cls", "refers_to").agg(F.min("column").alias("column"))
    declared = _declared(found).join(twins, ["cls", "refers_to"], "left").select("cls", "refers_to", "kind", F.coalesce("column", "via").alias("via"), F.lit(True).alias("declared"))
    return declared.unionByName(implicit_relations(found).select("cls", "refers_to", F.lit("implicit").alias("kind"), F.col("column").alias("via"), F.lit(False).alias("declared")))
