"""Contracts of the builder, groups, windows, mutations and sessions on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from relkit.entity import Collection, Default, DefaultKind, Entity, Index, ManyToMany, Property, Reference, VersionKind
from relkit.functions import expr as e
from relkit.functions import fulltext
from relkit.operators import mutate
from relkit.operators.includes import IncludeError
from relkit.operators.query import Query, split_clause, split_list
from relkit.operators.windows import CURRENT, UNBOUNDED_FOLLOWING, UNBOUNDED_PRECEDING, bound
from relkit.plans.capture import Capture
from relkit.plans.session import Session, current, scope
from relkit.sources.catalog import Catalog
from relkit.sources.repository import NotSingleError, Repository
from relkit.streaming.cursor import Job, iterate


def keyed(name, /, key="id", navigations=None, **types):
    return Entity(name, tuple(Property(n, t, primary_key=n == key) for n, t in types.items()), navigations or {})


ENTITIES = [
    keyed("companies", id="int", name="string", navigations={"employees": Collection("authors", "company_id")}),
    keyed("authors", id="int", name="string", company_id="int", navigations={"company": Reference("company_id", "companies"), "books": Collection("books", "author_id"), "categories": ManyToMany("categories", "author_categories", "author_id", "category_id")}),
    keyed("books", id="int", title="string", author_id="int", publisher_id="int", navigations={"author": Reference("author_id", "authors"), "publisher": Reference("publisher_id", "companies")}),
    keyed("categories", id="int", name="string", navigations={"authors": ManyToMany("authors", "author_categories", "category_id", "author_id")}),
    keyed("people", id="int", first="string", department="string", age="int", salary="double"),
]
PEOPLE = [(1, "John", "IT", 30, 50000.0), (2, "Jane", "HR", 35, 60000.0), (3, "Bob", "IT", 28, 45000.0), (4, "Alice", "Finance", 42, 70000.0), (5, "Eve", "IT", 51, None)]


@pytest.fixture(scope="module")
def c(spark):
    out = Catalog(spark, None, ENTITIES)
    for name, schema, data in (
        ("companies", "id int, name string", [(1, "Orwell Publishing"), (2, "Asimov Press"), (3, "Tech Solutions")]),
        ("authors", "id int, name string, company_id int", [(1, "George Orwell", 1), (2, "Isaac Asimov", 2), (3, "Jane Austen", None), (4, "Tech Writer", 3)]),
        ("books", "id int, title string, author_id int, publisher_id int", [(1, "1984", 1, 1), (2, "Animal Farm", 1, 1), (3, "Foundation", 2, 2), (4, "I, Robot", 2, 2), (5, "Pride and Prejudice", 3, None), (6, "Tech Manual", 4, 3)]),
        ("categories", "id int, name string", [(1, "Fiction"), (2, "Science Fiction"), (3, "Classic")]),
        ("author_categories", "id int, author_id int, category_id int", [(1, 1, 1), (2, 1, 3), (3, 2, 2), (4, 3, 3), (5, 3, 3)]),
        ("people", "id int, first string, department string, age int, salary double", PEOPLE),
    ):
        out = out.put(name, spark.createDataFrame(data, schema))
    return out


def q(c, name="people"):
    return Query.of(c, name)


def test_builder_is_immutable_and_filters_act_below_pages(c):
    base = q(c)
    narrow = base.where(lambda t: t.department == "IT")
    assert base.count() == 5 and narrow.count() == 3
    assert [r.id for r in base.order_by("id").take(1).where(lambda t: t.age > 40).execute()] == [4]


def test_order_and_pages(c):
    with pytest.raises(ValueError):
        q(c).then_by("id")
    found = q(c).order_by("department").then_by_descending("age").select("id").execute()
    assert [r.id for r in found] == [4, 2, 5, 1, 3]
    assert [r.id for r in q(c).order_by("salary").take(2).execute()] == [5, 3]  # nulls first
    assert [r.id for r in q(c).order_by("id").skip(1).take(2).execute()] == [2, 3]
    assert q(c).take(0).count() == 0


def test_raw_filter_escapes_its_values(c):
    assert q(c).where_raw("first = {0}", "O'Brien\\").count() == 0
    assert q(c).where_raw("age > {0} AND department = {1}", 29, "IT").count() == 2
    assert split_list("a, f(b, c), 'x,y' AS d") == ["a", "f(b, c)", "'x,y' AS d"]


def test_scalars_of_nothing(c):
    none = q(c).where(lambda t: t.age > 100)
    assert (none.sum("salary"), none.average("salary"), none.min("age"), none.count(), none.any()) == (0, 0, None, 0, False)


def test_reads(c):
    r = Repository(c, "people")
    assert r.read_first(F.col("age") > 100) is None
    assert r.read_single(F.col("id") == 2).first == "Jane"
    assert r.read_single_or_default(F.col("id") == 9) is None
    for f in (r.read_single, r.read_single_or_default):
        with pytest.raises(NotSingleError):
            f(F.col("department") == "IT")
    with pytest.raises(NotSingleError):
        r.read_single(F.col("id") == 9)
    assert r.read_by_id(4).first == "Alice" and r.exists_by_id(4) and not r.exists_by_id(9)
    assert sorted(x.id for x in r.iterate()) == [1, 2, 3, 4, 5]
    assert r.from_sql("SELECT count(*) AS n FROM people WHERE age > :least", {"least": 30}).first().n == 3


def test_includes(c):
    books = {r.id: r for r in q(c, "books").include("author").then_include("company").include("publisher").execute()}
    assert books[1].author.name == "George Orwell" and books[1].author.company.name == "Orwell Publishing"
    assert books[5].author.company is None and books[5].publisher is None
    authors = {r.id: r for r in q(c, "authors").include("books").include("categories").execute()}
    assert [b.title for b in authors[1].books] == ["1984", "Animal Farm"]
    assert [x.name for x in authors[1].categories] == ["Fiction", "Classic"]
    assert authors[4].categories == [] and [x.name for x in authors[3].categories] == ["Classic"]
    companies = {r.id: r for r in q(c, "companies").include("employees").then_include("books").execute()}
    assert [len(a.books) for a in companies[2].employees] == [2]
    assert q(c, "books").include("author").where(lambda t: t["author.name"] == "Isaac Asimov").count() == 2


def test_include_errors(c):
    for bad in (lambda: q(c, "books").include("author").include("author"), lambda: q(c, "books").include("nothing"), lambda: q(c, "books").include("author.books"), lambda: q(c, "authors").include("company.employees")):
        with pytest.raises(IncludeError):
            bad()
    with pytest.raises(ValueError):
        q(c, "books").then_include("author")


def test_not_in_has_three_values(c):
    publishers = q(c, "books").select("publisher_id")
    assert q(c, "companies").where_not_in("id", publishers).count() == 0  # one is null
    assert q(c, "authors").where_in("company_id", publishers).count() == 3
    assert q(c, "authors").where_not_in("company_id", q(c, "companies").where(F.col("id") == 1), "id").count() == 2
    with pytest.raises(ValueError):
        q(c, "authors").where_in("id", q(c, "books"))


def test_not_in_broadcasts_no_values(spark, c):
    """Spark's null-aware anti join broadcasts all values, whatever the threshold."""
    nulled = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    c = Catalog(spark, None, [keyed("nulled", key="k", k="int", v="int")]).put("nulled", nulled)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for values, kept in (([5], []), ([6], [1]), ([6, None], []), ([None], []), ([], [1, 2])):
            sub = spark.createDataFrame([(x,) for x in values], "x int")
            sub.createOrReplaceTempView("not_in_values")
            for found in (q(c, "nulled").where_not_in("v", sub), q(c, "nulled").where_not_in_raw("v", "SELECT x FROM not_in_values"), q(c, "nulled").with_cte("n", "SELECT x FROM not_in_values").where_not_in_raw("v + 0", "SELECT x FROM n")):
                df = found.build()
                assert sorted(r.k for r in df.collect()) == kept, values
                assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        # what the text of a subquery may be besides: tied to the outer rows, of several columns, a list
        raw = lambda key, sql: sorted(r.k for r in q(c, "nulled").where_not_in_raw(key, sql).execute())
        spark.createDataFrame([(1, 5), (1, 2)], "a int, b int").createOrReplaceTempView("not_in_values")
        assert raw("k", "SELECT a FROM not_in_values WHERE b = v") == [2] and raw("(k, k)", "SELECT a, b FROM not_in_values") == [1, 2] and raw("k", "2, 3") == [1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.catalog.dropTempView("not_in_values")


def test_not_in_with_null_broadcasts_no_values(spark):
    from relkit.queries import QUERIES

    df = QUERIES["where_not_in_with_null"](spark, "/root/testdata/sf0.001")
    assert [r.n for r in df.collect()] == [0]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti, (o_orderkey" in plan and "isnull((o_orderkey" not in plan and "strategy=merge" in plan


def test_typed_join_deals_pairs_to_tasks(spark, monkeypatch):
    """Few nations have many rows each, and rows out grow with the square of the input: no task gets a large part of them."""
    from relkit.operators import query
    from relkit.queries import QUERIES

    wanted = sorted(QUERIES["join_typed"](spark, "/root/testdata/sf0.01").collect())
    monkeypatch.setattr(query, "PAIRS", 20, raising=False)
    df = QUERIES["join_typed"](spark, "/root/testdata/sf0.01")
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(df.collect()) == wanted and sum(sizes) == len(wanted) > 600 and max(sizes) < 0.2 * sum(sizes)


@pytest.mark.parametrize("pairs", [1, 40, 1000, 10**6])
def test_spread_join_is_a_join(spark, monkeypatch, pairs):
    """Null keys, equal rows, sides of unlike length and types, one key, no rows."""
    from relkit.operators import query

    monkeypatch.setattr(query, "PAIRS", pairs, raising=False)
    many = spark.createDataFrame([(None if i % 9 == 0 else i % 2, i // 3) for i in range(90)], "a int, x int")
    few = spark.createDataFrame([(0, 5), (0, 5), (1, 20), (None, 1), (7, 1)], "b bigint, y int")
    c = Catalog(spark, None, [keyed("many", key="x", a="int", x="int"), keyed("few", key="y", b="bigint", y="int")]).put("many", many).put("few", few)
    on = (F.col("a") == F.col("b")) & (F.col("x") > F.col("y"))
    for left, right, key, other in (("many", "few", "a", "b"), ("few", "many", "b", "a")):
        for narrow in (F.lit(True), F.col("x") < 0, F.col("a") == 1):
            l, r = (q(c, name).where(narrow) if name == "many" else q(c, name) for name in (left, right))
            spread, plain = l.join_spread(r, on, key, other).build(), l.join(r, on).build()
            assert spread.columns == plain.columns and sorted(spread.collect()) == sorted(plain.collect())


def test_groups(c):
    g = q(c).group_by("department")
    assert {tuple(r) for r in g.having(lambda x: x.count() > 2).select(n=F.count("*"), total=F.sum("salary")).collect()} == {("IT", 3, 95000.0)}
    kept = g.having(lambda x: (x.count() > 2) | (x.department == "HR"))
    assert {r.department: len(r.members) for r in kept.members().collect()} == {"IT": 3, "HR": 1}
    assert kept.rows().count() == 4 and g.count() == 5 and g.sum("age") == 186
    assert {r.old for r in q(c).group_by(old=lambda t: t.age > 40).select(n=F.count("*")).collect()} == {True, False}
    with pytest.raises(ValueError):
        q(c).having(lambda g: g.count() > 1)
    with pytest.raises(AttributeError):
        g.having(lambda x: x.salary > 1).select(n=F.count("*"))


def test_windows(c):
    assert [bound(x) for x in ("unbounded preceding", "2 PRECEDING", "1 following", "CURRENT ROW", "what", "UNBOUNDED FOLLOWING")] == [UNBOUNDED_PRECEDING, -2, 1, CURRENT, CURRENT, UNBOUNDED_FOLLOWING]
    w = q(c).window("department", "age")
    found = {r.id: (r.n, r.prev, r.total) for r in w.rows(1, 0).row_number("n").lag("prev", "age", 1, -1).sum("total", "age").end().execute()}
    assert found[1] == (2, 28, 58) and found[3] == (1, -1, 28)
    with pytest.raises(ValueError):
        q(c).window("department").rank("r")
    with pytest.raises(ValueError):
        w.rows_between("1 following", "1 preceding").count("n")
    with pytest.raises(NotImplementedError):
        w.groups(1, 1)


def test_sets_and_ctes(c):
    it, old = q(c).where(lambda t: t.department == "IT").select("id"), q(c).where(lambda t: t.age > 40).select("id")
    ids = lambda x: sorted(r.id for r in x.execute())
    assert ids(it.union(old)) == [1, 3, 4, 5] and ids(it.union_all(old)) == [1, 3, 4, 5, 5]
    assert ids(it.intersect(old)) == [5] and ids(it.except_(old)) == [1, 3]
    deep = q(c).with_recursive_cte("s", "SELECT 1 AS n", "SELECT n + 1 FROM s WHERE n < 120", levels=150).from_raw("s")
    assert deep.count() == 120
    assert q(c).with_cte("old", "SELECT id FROM people WHERE age > 40").join_raw("JOIN old ON old.id = t0.id").count() == 2


def test_scalar_edges(spark):
    row = spark.range(1).select(e.divide(F.lit(1), F.lit(0)).alias("a"), e.int_div(F.lit(-7), F.lit(2)).alias("b"), e.is_in(F.lit(1), []).alias("c"), e.greatest(F.lit(1), F.lit(None)).alias("d"), e.round_(F.lit(2.5)).alias("e"), e.add(e.date(2024, 1, 31), months=1).alias("f"), e.substring(F.lit("hello"), 1, 3).alias("g"), e.any_of([]).alias("h"), e.modulo(F.lit(5), F.lit(0)).alias("i"), e.array(1, 2).alias("j")).first()
    assert tuple(row) == (None, -3, False, None, 3.0, datetime.datetime(2024, 2, 29), "ell", False, None, [1, 2])
    with pytest.raises(ValueError):
        e.Case().column()


def test_fulltext(spark):
    df = spark.createDataFrame([(1, "Spark makes big data simple"), (2, "Simple things, sparkling"), (3, None), (4, "")], "id int, t string")
    ids = lambda p: [r.id for r in df.where(p).orderBy("id").collect()]
    assert ids(fulltext.natural("spark things", "t")) == [1, 2] and ids(fulltext.natural("", "t")) == []
    assert ids(fulltext.boolean("+simple -data", "t")) == [2] and ids(fulltext.boolean("spark*", "t")) == [1, 2]
    assert ids(fulltext.boolean('"big data"', "t")) == [1] and ids(fulltext.boolean('"data big"', "t")) == []
    assert ids(fulltext.expanded("huge", "t", related={"huge": ["big"]})) == [1]


def test_mutations(c, spark):
    people = c.frame("people")
    raised = mutate.update(people, F.col("department") == "IT", salary=F.col("age") * 1.0, age=F.col("salary").cast("int"))
    got = {r.id: (r.salary, r.age) for r in raised.after.collect()}
    assert raised.count() == 3 and got[1] == (30.0, 50000) and got[2] == (60000.0, 35)
    assert mutate.delete(people, F.col("salary") > 50000).after.count() == 3  # the null stays
    with pytest.raises(ValueError):
        mutate.update(people, F.lit(True), nothing=1)
    new = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (9, "C", 1)], "id int, first string, at int")
    after = {r.id: r.first for r in mutate.upsert(c.entity("people"), people, new, "at").after.collect()}
    assert after[1] == "B" and after[9] == "C" and len(after) == 6


def test_create_fills_in(spark):
    entity = Entity("t", (Property("id", "int", primary_key=True, auto_increment=True), Property("name", "string", default=Default(DefaultKind.STATIC, "none")), Property("flag", "boolean", default=Default(DefaultKind.TRUE, only_if_null=False)), Property("v", "int", version=VersionKind.INTEGER)))
    base = spark.createDataFrame([(4, "x", False, 3)], "id int, name string, flag boolean, v int")
    made = mutate.create(entity, base, spark.createDataFrame([("b", False), (None, False)], "name string, flag boolean"), order=["name"])
    assert sorted(tuple(r) for r in made.after.collect()) == [(4, "x", False, 3), (5, "none", True, 1), (6, "b", True, 1)]
    for kind in DefaultKind:
        if kind not in (DefaultKind.STATIC, DefaultKind.PROVIDER):
            assert spark.range(1).select(Default(kind).expression(F.lit(None))).first()[0] is not None


def test_versions_and_resolvers(spark):
    entity = Entity("t", (Property("id", "int", primary_key=True), Property("a", "string"), Property("b", "string"), Property("v", "int", version=VersionKind.INTEGER)))
    schema = "id int, a string, b string, v int"
    base = spark.createDataFrame([(1, "a", "b", 1), (2, "a", "B", 2), (3, "A", "b", 2)], schema)
    sent = spark.createDataFrame([(1, "x", "b", 1), (2, "x", "b", 1), (3, "x", "b", 1)], schema)
    read = spark.createDataFrame([(1, "a", "b", 1), (2, "a", "b", 1), (3, "a", "b", 1)], schema)
    strict = mutate.update_versioned(entity, base, sent)
    assert strict.applied.count() == 1 and strict.conflicts.count() == 2
    with pytest.raises(mutate.ConcurrencyError):
        strict.or_raise()
    after = lambda r: {x.id: (x.a, x.b, x.v) for x in mutate.update_versioned(entity, base, sent, resolver=r, original=read).after.collect()}
    assert after(mutate.client_wins)[2] == ("x", "b", 3)
    assert after(mutate.database_wins)[2] == ("a", "B", 3)
    assert after(mutate.merge_changes())[2] == ("x", "B", 3) and after(mutate.merge_changes())[3] == ("x", "b", 3)
    assert after(mutate.merge_changes(both="current"))[3] == ("A", "b", 3)
    assert after(mutate.merge_changes(ignored=("a",)))[2] == ("a", "B", 3)
    with pytest.raises(Exception, match="both sides"):
        after(mutate.merge_changes(both="throw"))


def test_updates_of_rows_that_are_not_there_or_come_twice(spark, c):
    entity = Entity("t", (Property("id", "int", primary_key=True), Property("a", "string"), Property("v", "int", version=VersionKind.INTEGER)))
    schema = "id int, a string, v int"
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema)
    gone = mutate.update_versioned(entity, base, spark.createDataFrame([(1, "x", 1), (7, "x", 1)], schema))
    assert gone.applied.count() == 1 and gone.missing.count() == 1 and gone.after.count() == 2
    with pytest.raises(mutate.MissingRowError):
        gone.or_raise()
    twice = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (2, "z", 1)], schema)
    for resolver in (None, mutate.client_wins):
        out = mutate.update_versioned(entity, base, twice, resolver=resolver)
        assert sorted(tuple(r) for r in out.after.collect()) == [(1, "a", 1), (2, "z", 2)] and out.conflicts.count() == 2
        with pytest.raises(mutate.ConcurrencyError):
            out.or_raise()
    with pytest.raises(ValueError, match="original"):
        mutate.update_versioned(entity, base, twice, resolver=mutate.merge_changes())
    with pytest.raises(mutate.MissingRowError):
        Repository(c, "people").update(spark.createDataFrame([(99, "No")], "id int, first string"))
    # without a column that says when, rows arrive in their own order
    many = spark.createDataFrame([(2, "p", 1), (2, "q", 1), (3, "r", 1)], schema)
    assert sorted((r.id, r.a) for r in mutate.upsert(entity, base, many).after.collect()) == [(1, "a"), (2, "q"), (3, "r")]


def test_keys_are_numbered_in_parallel(spark):
    entity = Entity("t", (Property("id", "bigint", primary_key=True, auto_increment=True), Property("n", "bigint")))
    base = spark.createDataFrame([(40, -1)], "id bigint, n bigint")
    new = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("n")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = mutate.create(entity, base, new, order=["n"]).touched
        assert made.rdd.getNumPartitions() > 1
        assert sorted((r.id, r.n) for r in made.collect()) == [(41 + i, i) for i in range(1000)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_raw_subqueries_and_statements_see_the_catalogue(spark, c):
    for name in ("books", "people", "companies"):
        spark.catalog.dropTempView(name)
    assert q(c, "companies").where_in_raw("id", "SELECT publisher_id FROM books").count() == 3
    assert q(c, "companies").where_not_in_raw("id", "SELECT publisher_id FROM books WHERE publisher_id > 1").count() == 1
    r = Repository(c, "people", Session(c))
    assert [tuple(x) for x in r.from_sql("SELECT count(*), max(name) FROM people CROSS JOIN companies", result="n int, most string").collect()] == [(15, "Tech Solutions")]
    assert r.execute_sql("update people set department = 'a = b, where c', age = age + 1 where id in (select author_id from books)") == 4
    assert {x.department for x in r.read_many(F.col("id") < 5).collect()} == {"a = b, where c"} and r.table.where("id = 1").first().age == 31
    assert r.execute_sql("DELETE FROM people WHERE salary > 50000;") == 2
    assert r.execute_sql("INSERT INTO people (id, first) VALUES (8, 'Kim'), (9, 'Lou')") == 2 and r.count() == 5
    assert r.execute_sql("DELETE FROM people") == 5 and r.count() == 0
    for bad in ("SELECT 1", "DELETE FROM books", "MERGE INTO people"):
        with pytest.raises(ValueError):
            r.execute_sql(bad)
    assert split_clause("a = 'x where y', b = (select 1 where true) WHERE c", "WHERE") == ("a = 'x where y', b = (select 1 where true) ", " c")
    assert q(c).where(lambda t: t.age > 40).order_by("id").take(1).delete().after.count() == 4


def test_session(c):
    s = Session(c)
    r = Repository(c, "people", s)
    r.delete_many(F.col("department") == "HR")
    s.savepoint("one")
    r.delete_all()
    assert r.count() == 0
    s.rollback_to("one")
    assert r.count() == 4 and c.frame("people").count() == 5
    s.release("one")
    with pytest.raises(KeyError):
        s.rollback_to("one")


def test_scope(c):
    with scope(c) as outer:
        r = Repository(c, "people", current())
        r.delete_by_id(1)
        with scope():
            r.delete_all()
        assert r.count() == 4  # the inner one was not completed
        outer.complete()
    assert r.count() == 4 and current() is None
    with pytest.raises(RuntimeError), scope(c) as own:
        own.complete()
        session = current()
        Repository(c, "people", session).delete_all()
        raise RuntimeError
    assert session.catalog.frame("people").count() == 5


def test_schema(c, spark):
    entity = keyed("t", id="int", name="string")
    assert entity.validate(None) == ([], ["table t does not exist"])
    assert entity.validate(spark.createDataFrame([(1, 2)], "id int, other int")) == (["column name is missing from t"], ["column other of t is not part of t"])
    assert Entity("t", (Property("a", "int"),)).validate(None)[0] == ["t must have one primary key"]
    with pytest.raises(ValueError):
        _ = Entity("t", (Property("a", "int"),)).key
    assert entity.ddl() == "CREATE TABLE IF NOT EXISTS `t` (`id` INT, `name` STRING) USING parquet"
    assert entity.schema()["id"].metadata["primary_key"]
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (None, "z")], "id int, name string")
    assert [tuple(r) for r in entity.violations(twice, Index("u", ("id",), unique=True)).collect()] == [(1, 2)]
    assert not c.has("nothing") and c.has("people")


def test_changes_capture_and_cursor(c):
    people = c.frame("people")
    diff = mutate.changes(people, mutate.update_field(people, F.col("id") == 5, "salary", 1.0).after, "id")
    assert [tuple(r) for r in diff.collect()] == [(5, "salary", None, "1.0")]
    cap = Capture()
    result = cap.run(q(c).where(lambda t: t.age > 40).order_by("id"))
    assert "WHERE" in cap.last and "ORDER BY" in result.query and "Physical Plan" in result.plan
    assert len(list(iterate(people))) == 5
    assert Job(people, lambda d: d.count()).result(60) == 5
