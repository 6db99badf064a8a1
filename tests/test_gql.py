import pytest

from tidemark.errors import GraphQLError, UniqueViolation
from tidemark.gql.document import Enum, Variable, parse
from tidemark.plans.expr import col
from .fixtures import charts, harbour


@pytest.fixture()
def db(spark):
    return harbour(spark)


def data(db, text, variables=None, operation=None):
    return db.graphql(text, variables, operation)["data"]


def test_parser():
    (op,) = parse('query Q($a: [Int!]! = [1, 2], $b: String) { x: f(a: $a, o: {k: RED, s: "q\\n", n: -1.5e2, t: true, z: null}) @include(if: $b) { id, # comment\n name } }')
    s = op.selections[0]
    assert (op.name, op.variables[0].type, op.variables[0].default, op.variables[1].has_default) == ("Q", "[Int!]!", [1, 2], False)
    assert (s.key, s.name, s.arguments["a"], s.arguments["o"]) == ("x", "f", Variable("a"), {"k": Enum("RED"), "s": "q\n", "n": -150.0, "t": True, "z": None})
    assert [c.name for c in s.selections] == ["id", "name"]
    for bad in ("{ a ...F }", "fragment F on T { a }", "{ }", "{ a(", "query { a } }", "{ a ~ }", ""):
        with pytest.raises(GraphQLError):
            parse(bad)


def test_sdl(db):
    sdl = db.graphql_schema()
    for part in ("type Query", "type Mutation", "type Subscription", "insertShips(", "ship: Ships", "trips(", "enum TripsOrderField {\n  ID\n  SHIP_ID\n  TONS\n}", "tripsByPk(pk: TripsPkInput!): Trips", "input LongFilter"):
        assert part in sdl


def test_nested_relations(db):
    found = data(db, "{ ships(orderBy: [{field: ID}]) { name trips(orderBy: [{field: TONS, direction: DESC}], limit: 1) { tons ship { name __typename } } } }")
    assert found == {
        "ships": [
            {"name": "Alba", "trips": [{"tons": 75, "ship": {"name": "Alba", "__typename": "Ships"}}]},
            {"name": "Brisa", "trips": [{"tons": 60, "ship": {"name": "Brisa", "__typename": "Ships"}}]},
            {"name": "Corvo", "trips": []},
            {"name": "Dorsal", "trips": [{"tons": 60, "ship": {"name": "Dorsal", "__typename": "Ships"}}]},
        ]
    }


def test_children_without_a_page_are_in_key_order(db):
    found = data(db, "{ ships(limit: 2, orderBy: [{field: NAME}]) { name trips { id } } }")
    assert found == {"ships": [{"name": "Alba", "trips": [{"id": 21}, {"id": 22}, {"id": 25}]}, {"name": "Brisa", "trips": [{"id": 23}]}]}


def test_relations_are_read_for_the_keys_above(db):
    """Below a restricted root the other table is filtered before it is gathered."""
    frame = db.prepare_graphql("{ shipsByPk(pk: {id: 1}) { name trips { id } } }").frame()
    assert "LeftSemi" in frame._jdf.queryExecution().optimizedPlan().toString()
    whole = db.prepare_graphql("{ ships { name trips { id } } }").frame()
    assert "LeftSemi" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_filters_and_variables(db):
    text = "query A($min: Long!, $full: Boolean = false) { trips(where: {tons: {gte: $min, lt: 75}, OR: [{id: {eq: 21}}, {id: {in: [23, 24]}}]}, orderBy: {field: ID, direction: DESC}) { id tons @include(if: $full) } }"
    assert data(db, text, {"min": 40}) == {"trips": [{"id": 24}, {"id": 23}, {"id": 21}]}
    assert data(db, text, {"min": 41, "full": True}) == {"trips": [{"id": 24, "tons": 60}, {"id": 23, "tons": 60}]}
    for text, variables in ((text, {}), ("{ nope { id } }", None), ("{ trips { nope } }", None), ("{ trips(first: 1) { id } }", None), ("{ trips { id @skip(if: true) @skip(if: true) } }", None), ("{ trips(where: {id: {about: 1}}) { id } }", None)):
        with pytest.raises(Exception):
            data(db, text, variables)


def test_by_pk_and_missing_parent(db):
    assert data(db, "{ a: tripsByPk(pk: {id: 22}) { tons } b: tripsByPk(pk: {id: 99}) { tons } }") == {"a": {"tons": 75}, "b": None}
    db.graphql("mutation { deleteShips(where: {id: {eq: 2}}) { id } }")
    assert data(db, "{ trips(where: {id: {eq: 23}}) { ship { name } } }") == {"trips": [{"ship": None}]}


def test_mutations(db):
    made = data(db, 'mutation M($n: String!) { insertShips(input: [{id: 5, name: $n}]) { id name } updateTrips(where: {ship_id: {eq: 1}}, orderBy: [{field: TONS}], limit: 2, set: {tons: 1}) { id tons } deleteTrips(where: {id: {eq: 22}}) { id ship { name } } }', {"n": "Eider"})
    assert made == {"insertShips": [{"id": 5, "name": "Eider"}], "updateTrips": [{"id": 21, "tons": 1}, {"id": 25, "tons": 1}], "deleteTrips": [{"id": 22, "ship": {"name": "Alba"}}]}
    assert data(db, "{ trips(orderBy: [{field: ID}]) { id tons } }") == {"trips": [{"id": 21, "tons": 1}, {"id": 23, "tons": 60}, {"id": 24, "tons": 60}, {"id": 25, "tons": 1}]}


def test_a_mutation_is_all_or_nothing(db):
    with pytest.raises(UniqueViolation):
        data(db, 'mutation { deleteTrips(where: {id: {eq: 21}}) { id } insertShips(input: [{id: 1, name: "again"}]) { id } }')
    assert len(data(db, "{ trips { id } }")["trips"]) == 5


def test_subscriptions(db):
    live = db.subscribe_graphql("subscription { shipsByPk(pk: {id: 3}) { name trips { tons } } }")
    assert live.get_result() == {"data": {"shipsByPk": {"name": "Corvo", "trips": []}}}
    seen = []
    end = live.subscribe(seen.append)
    db.graphql('mutation { insertDues(input: [{id: 1, trip_id: 21, kind: "x", paid: true}]) { id } }')
    assert seen == []
    db.graphql("mutation { insertTrips(input: [{id: 50, ship_id: 3, tons: 9}]) { id } }")
    assert seen == [{"data": {"shipsByPk": {"name": "Corvo", "trips": [{"tons": 9}]}}}]
    end()
    assert live.subscription_count() == 0
    db.graphql("mutation { deleteTrips(where: {id: {eq: 50}}) { id } }")
    assert len(seen) == 1 and live.get_result() == {"data": {"shipsByPk": {"name": "Corvo", "trips": []}}}


def test_plain_subscriptions_are_patched(db, monkeypatch):
    from tidemark.gql import execute

    live = db.subscribe_graphql("subscription { trips(where: {tons: {gt: 50}}) { no: id tons } }")
    seen = []
    live.subscribe(seen.append)
    monkeypatch.setattr(execute, "run", None)  # nothing is evaluated again
    db.insert("trips").values([{"id": 20, "ship_id": 3, "tons": 51}, {"id": 30, "ship_id": 3, "tons": 50}]).exec()
    db.update("trips").set({"tons": 61}).where(col("id").eq(23)).exec()
    assert [[(r["no"], r["tons"]) for r in x["data"]["trips"]] for x in seen] == [[(20, 51), (22, 75), (23, 60), (24, 60)], [(20, 51), (22, 75), (23, 61), (24, 60)]]


def test_prepared_and_named_operations(db):
    prepared = db.prepare_graphql("query A { trips { id } } query B($i: Long!) { tripsByPk(pk: {id: $i}) { tons } }")
    assert prepared.exec({"i": 21}, "B") == {"data": {"tripsByPk": {"tons": 40}}}
    with pytest.raises(GraphQLError):
        prepared.exec()


def test_json_filters(spark):
    db = charts(spark)
    one = lambda where: [r["id"] for r in data(db, f"{{ charts(where: {{notes: {where}}}) {{ id }} }}")["charts"]]
    assert one('{path: "$.scale", eq: "fine"}') == [1, 3]
    assert one('{path: "$.drawn", exists: true}') == [1, 2, 3]
    assert one('{path: "$.kinds", contains: ["wrecks"]}') == [1, 3]
    assert one('{path: "$.drawn", eq: {by: "Iker"}}') == [2]
    assert one("{isNull: true}") == [5]
