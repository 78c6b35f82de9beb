"""The entities of the benchmark tables."""

from relkit.entity import Collection, Entity, Index, ManyToMany, Property, Reference, VersionKind
from relkit.sources.catalog import Catalog


def _properties(key: str | None, **types: str) -> tuple[Property, ...]:
    return tuple(Property(n, t, primary_key=n == key) for n, t in types.items())


ENTITIES = [
    Entity("region", _properties("r_regionkey", r_regionkey="int", r_name="string"), {"nations": Collection("nation", "n_regionkey")}),
    Entity("nation", _properties("n_nationkey", n_nationkey="int", n_name="string", n_regionkey="int"), {"region": Reference("n_regionkey", "region"), "customers": Collection("customer", "c_nationkey")}),
    Entity("customer", _properties("c_custkey", c_custkey="bigint", c_name="string", c_nationkey="int", c_acctbal="double", c_mktsegment="string"), {"nation": Reference("c_nationkey", "nation"), "orders": Collection("orders", "o_custkey")}),
    Entity("supplier", _properties("s_suppkey", s_suppkey="bigint", s_name="string", s_nationkey="int", s_acctbal="double"), {"nation": Reference("s_nationkey", "nation")}),
    Entity("part", _properties("p_partkey", p_partkey="bigint", p_name="string", p_brand="string", p_type="string", p_size="int", p_retailprice="double"), {"orders": ManyToMany("orders", "lineitem", "l_partkey", "l_orderkey")}),
    Entity("orders", _properties("o_orderkey", o_orderkey="bigint", o_custkey="bigint", o_orderstatus="string", o_totalprice="double", o_orderdate="timestamp_ntz", o_orderpriority="string"), {"customer": Reference("o_custkey", "customer"), "parts": ManyToMany("part", "lineitem", "l_orderkey", "l_partkey")}, (Index("ux_orders", ("o_orderkey",), unique=True), Index("ix_orders_customer", ("o_custkey",)))),
    Entity("lineitem", _properties(None, l_orderkey="bigint", l_partkey="bigint", l_suppkey="bigint", l_linenumber="int", l_quantity="double", l_extendedprice="double", l_discount="double", l_tax="double", l_returnflag="string", l_linestatus="string", l_shipdate="timestamp_ntz"), indexes=(Index("ux_lineitem", ("l_orderkey", "l_linenumber"), unique=True),)),
    Entity("events", _properties("event_id", event_id="bigint", ts="timestamp_ntz", user_id="bigint", event_type="string", value="double", props="string")),
    Entity("documents", _properties("doc_id", doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint")),
    # a table with versions, for optimistic updates
    Entity("versioned_customer", (Property("c_custkey", "bigint", primary_key=True), Property("c_name", "string"), Property("c_acctbal", "double"), Property("version", "int", version=VersionKind.INTEGER))),
]


def catalog(spark, folder: str) -> Catalog:
    return Catalog(spark, folder, ENTITIES)
