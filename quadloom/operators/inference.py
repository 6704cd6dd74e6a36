"""RDFS closures: classes, properties, domains and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.operators.recursion import closure

RDF, RDFS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
TYPE, CLASS, PROPERTY, RESOURCE = RDF + "type", RDFS + "Class", RDF + "Property", RDFS + "Resource"
SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"


class Schema:
    """What the quads of a store say about classes and properties; quads that change give a new Schema over the new store."""

    def __init__(self, store):
        self.store, self.spark = store, store.spark

    def _pairs(self, predicate: str) -> DataFrame:
        return self.store.quads.where(F.col("p") == f"<{predicate}>").select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()

    def _typed(self, kind: str) -> DataFrame:
        return self._pairs(TYPE).where(F.col("b") == f"<{kind}>").select(F.col("a").alias("id"))

    def classes(self) -> DataFrame:
        """(id): declared, or used as a class."""
        sub, t = self._pairs(SUB_CLASS), self._pairs(TYPE).where(~F.col("b").isin(f"<{CLASS}>", f"<{PROPERTY}>"))
        used = [self._typed(CLASS), sub.select("a"), sub.select("b"), t.select("b"), self._pairs(DOMAIN).select("b"), self._pairs(RANGE).select("b")]
        out = self.spark.createDataFrame([(f"<{RESOURCE}>",)], "id string")
        for u in used:
            out = out.union(u)
        return out.distinct()

    def properties(self) -> DataFrame:
        sub = self._pairs(SUB_PROPERTY)
        return self._typed(PROPERTY).union(sub.select("a")).union(sub.select("b")).union(self._pairs(DOMAIN).select("a")).union(self._pairs(RANGE).select("a")).distinct()

    def sub_classes(self) -> DataFrame:
        """(sub, super), transitive and reflexive; all are below rdfs:Resource."""
        known = self.classes()
        own = known.select(F.col("id").alias("a"), F.col("id").alias("b"))
        top = known.select(F.col("id").alias("a"), F.lit(f"<{RESOURCE}>").alias("b"))
        return closure(self._pairs(SUB_CLASS)).union(own).union(top).distinct().toDF("sub", "super")

    def sub_properties(self) -> DataFrame:
        known = self.properties()
        return closure(self._pairs(SUB_PROPERTY)).union(known.select(F.col("id").alias("a"), F.col("id").alias("b"))).distinct().toDF("sub", "super")

    def is_sub_class_of(self, sub, sup) -> bool:
        return not self.sub_classes().where((F.col("sub") == T.key(sub)) & (F.col("super") == T.key(sup))).isEmpty()

    def is_sub_property_of(self, sub, sup) -> bool:
        return not self.sub_properties().where((F.col("sub") == T.key(sub)) & (F.col("super") == T.key(sup))).isEmpty()

    def domains(self) -> DataFrame:
        """(property, class), from super-properties too."""
        return self._inherited(DOMAIN)

    def ranges(self) -> DataFrame:
        return self._inherited(RANGE)

    def _inherited(self, predicate: str) -> DataFrame:
        told = self._pairs(predicate).toDF("super", "class")
        return told.join(self.sub_properties(), "super").select(F.col("sub").alias("property"), "class").distinct()

    def types(self) -> DataFrame:
        """(id, class): types told, by domain and range, and of all super-classes."""
        q = self.store.quads.select("s", "p", "o")
        told = self._pairs(TYPE).toDF("id", "class")
        by_domain = q.join(self.domains(), q["p"] == F.col("property")).select(F.col("s").alias("id"), "class")
        by_range = q.where(F.col("o").startswith("<") | F.col("o").startswith("_:")).join(self.ranges(), q["p"] == F.col("property")).select(F.col("o").alias("id"), "class")
        direct = told.union(by_domain).union(by_range).distinct()
        above = self.sub_classes()
        return direct.join(above, direct["class"] == above["sub"]).select("id", F.col("super").alias("class")).union(direct).distinct()

    def entailed(self) -> DataFrame:
        """Quads that follow and aren't there: super-properties, types, and the closures themselves."""
        q = self.store.quads
        sub = self.sub_properties().where("sub != super")
        lifted = q.join(sub, q["p"] == sub["sub"]).select("s", F.col("super").alias("p"), "o")
        pairs = lambda df, p: df.select(F.col("sub").alias("s"), F.lit(f"<{p}>").alias("p"), F.col("super").alias("o"))
        more = lifted.union(self.types().select(F.col("id").alias("s"), F.lit(f"<{TYPE}>").alias("p"), F.col("class").alias("o")))
        more = more.union(pairs(self.sub_classes().where("sub != super"), SUB_CLASS)).union(pairs(sub, SUB_PROPERTY)).distinct()
        return more.join(q.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti").withColumn("l", F.lit(None).cast("string"))
