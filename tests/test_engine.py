"""Readers, identity, merging, projection and ranking end to end."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomfuse.operators.identity import clusters, star_edges
from loomfuse.operators.profiles import merge_clusters
from loomfuse.operators.projection import project, render
from loomfuse.operators.ranking import keyword_match, parse_keywords, rank
from loomfuse.operators.records import normalize_records
from loomfuse.plans.components import connected_components
from loomfuse.plans.config import OutputConfig
from loomfuse.plans.pipeline import Source, build_profiles, run
from loomfuse.sources.readers import detect_type, read_json, read_notes, read_resumes
from loomfuse.sources.schemas import RAW, as_raw

CSV = 'Full Name,E-mail,Mobile,Employer,Role,City,email\nAnn Lee,,(212) 555-0123,Initech,Engineer,"Austin, TX",ann@lee.org\n,,,,,,\nNo Contact,bad,12,,,,\n'
ATS = json.dumps({"results": [{"fullName": "Ann B. Lee", "contact": {"email": "ANN@lee.org", "phone": 5}, "address": {"city": "Austin", "country": "USA"}, "links": {"githubHandle": "annlee"}, "yearsOfExperience": 7, "skills": ["k8s", "PY"], "experience": [{"company": "Initech", "role": "Engineer", "since": "Mar 2020", "until": "present"}], "education": [{"university": "MIT", "degree": "B.S.", "year": 2015}]}, 3, {"note": 1}]})
NOTES = "Candidate: Ann Lee <ann@lee.org>\n~9 yrs, knows Spring Boot and Go.\n\nName: Bo Ray - lead\nPhone +34 612 345 678. Django\n"
RESUME = "Ann Lee\nStaff Engineer\nann@lee.org | github.com/annlee\n\nEXPERIENCE\nEngineer at Initech, Mar 2020 - Present\n- Built things\n- Fixed things\nIntern, Acme (2018 - 2019)\n\nEDUCATION\nB.S. in Physics, Some University, 2015\nSKILLS\nPython, Go | CI/CD\n"


def raw(spark, rows):
    keep = {k for r in rows for k in r}
    df = spark.createDataFrame([tuple(r.get(k) for k in sorted(keep)) for r in rows], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted((f for f in RAW if f.name in keep), key=lambda f: f.name)))
    return as_raw(df)


def texts(spark, text):
    return spark.createDataFrame([(0, "x", text)], "spec_idx int, path string, text string")


def test_detect_type():
    assert [detect_type(p) for p in ("a/B.CSV", "x.json", "cv_1.txt", "my resume.txt", "notes.txt", "a.docx", "b.pdf", "z.bin")] == ["recruiter_csv", "ats_json", "resume", "resume", "recruiter_notes", "resume", "resume", None]


def test_readers(spark, tmp_path):
    got = read_json(texts(spark, ATS)).orderBy("pos").collect()
    assert [r.full_name for r in got] == ["Ann B. Lee", None]
    assert got[0].years_num == 7 and got[0].github == "https://github.com/annlee" and got[0].skills == ["k8s", "PY"] and got[0].phones == ["5"]
    assert read_json(texts(spark, "{ bad,,")).count() == 0
    notes = read_notes(texts(spark, NOTES)).orderBy("pos").collect()
    assert [r.full_name for r in notes] == ["Ann Lee", "Bo Ray"]
    assert notes[0].years_txt == "9" and set(notes[0].skills) >= {"spring boot", "spring", "go"} and notes[1].phones == ["+34 612 345 678"]
    r = read_resumes(texts(spark, RESUME)).first()
    assert (r.full_name, r.headline, r.github) == ("Ann Lee", "Staff Engineer", "github.com/annlee")
    assert [(e.title, e.company, e.start, e.end, e.summary) for e in r.experience] == [("Engineer", "Initech", "Mar 2020", "Present", "Built things Fixed things"), ("Intern", "Acme (", "2018", "2019", None)]
    assert [tuple(e) for e in r.education] == [("Some University", "B.S.", "Physics", "2015")]
    assert r.skills == ["Python", "Go", "CI", "CD"]
    p = tmp_path / "people.csv"
    p.write_text("﻿" + CSV)
    from loomfuse.sources.readers import read_delimited

    rows = read_delimited(spark, str(p)).orderBy("pos").collect()
    assert [(x.full_name, x.emails, x.headline) for x in rows] == [("Ann Lee", ["ann@lee.org"], "Engineer"), ("No Contact", ["bad"], None)]


def test_docx(spark, tmp_path):
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in ("Ann Lee", "ann@lee.org"))
    with zipfile.ZipFile(tmp_path / "cv.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "broken.pdf").write_bytes(b"no")
    done = run(spark, [str(tmp_path / "cv.docx"), str(tmp_path / "broken.pdf")])
    assert [r.full_name for r in done.profiles.collect()] == ["Ann Lee"]
    assert [r.message for r in done.warnings.collect()] == ["contributed no records (broken.pdf cannot be read as a document)"]


def test_merge_conflict_and_list_items(spark):
    job = lambda c, t, s, e: [(c, t, s, e, None)]
    rows = [
        {"spec_idx": 0, "pos": 0, "source": "recruiter_csv", "full_name": "Ann Lee", "emails": ["a@b.co"], "experience": job("Initech", "Engineer", None, "present"), "headline": "Old"},
        {"spec_idx": 1, "pos": 0, "source": "resume", "full_name": "Ann B. Lee", "emails": ["A@b.co"], "experience": job("initech", "engineer", "Mar 2020", "2021"), "headline": "New", "skills": ["py", "Go"]},
        {"spec_idx": 1, "pos": 1, "source": "odd", "emails": ["a@b.co"], "skills": ["python"]},
    ]
    p = merge_clusters(clusters(normalize_records(raw(spark, rows)))).collect()
    assert len(p) == 1
    p = p[0]
    assert (p.full_name, p.headline) == ("Ann Lee", "New")
    assert [tuple(e) for e in p.experience] == [("initech", "engineer", "2020-03", "2021-01", None)]
    assert {s.name: (s.confidence, s.sources) for s in p.skills} == {"Python": (0.9, ["resume", "odd"]), "Go": (0.8, ["resume"])}
    assert [(e.field, e.source, e.method) for e in p.provenance][:2] == [("full_name", "recruiter_csv", "direct"), ("headline", "resume", "extracted")]


def test_separate_people_and_order_invariance(spark):
    rows = [{"spec_idx": 0, "pos": i, "source": "ats_json", "full_name": f"P {i // 2}", "emails": [f"e{i}@x.co"]} for i in range(8)] + [{"spec_idx": 1, "pos": 0, "source": "ats_json"}, {"spec_idx": 1, "pos": 1, "source": "ats_json"}]
    want = None
    for parts in (1, 4, 7):
        got = sorted(r.asDict(True).__repr__() for r in build_profiles(raw(spark, rows).repartition(parts)).drop("cluster").collect())
        assert len(got) == 6
        assert want is None or got == want
        want = got


def test_components_of_paths_rings_and_random_graphs(spark):
    r = random.Random(3)
    path = list(range(100, 164))
    r.shuffle(path)
    edges = list(zip(path, path[1:])) + [(200 + i, 200 + (i + 1) % 64) for i in range(64)] + [(r.randrange(300, 500), r.randrange(300, 500)) for _ in range(150)] + [(7, 7)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.u: x.label for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n: got.get(n, n) for n in parent} == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    keys = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "key string, n int")
    assert sorted(map(tuple, star_edges(keys, "key", "n").collect())) == [(2, 1), (3, 1)]


@pytest.fixture(scope="module")
def people(spark):
    sources = [Source(type="recruiter_csv", text=CSV), Source(type="ats_json", text=ATS), Source(type="resume", text=RESUME), Source(type="recruiter_notes", text=NOTES), Source(type="ats_json", text="{ not json"), Source(type="odd", text="x"), Source(type="resume", text="  ")]
    return run(spark, sources)


def test_end_to_end(people):
    got = [json.loads(r.json) for r in people.outputs.collect()]
    by = {p["full_name"]: p for p in got}
    assert set(by) == {"Ann Lee", "No Contact", "Bo Ray", None}
    ann = by["Ann Lee"]
    assert ann["emails"] == ["ann@lee.org"] and ann["phones"] == ["+12125550123"] and ann["location"] == {"city": "Austin", "region": "TX", "country": "US"}
    assert ann["experience"][0]["start"] == "2020-03" and ann["candidate_id"].startswith("cand_")
    assert [r.message for r in people.warnings.collect()] == ["contributed no records"]
    assert got == sorted(got, key=lambda p: p["candidate_id"])


def shaped(people, fields, **more):
    config = OutputConfig.from_dict({"fields": fields, "include_confidence": False, "include_provenance": False, **more})
    df = project(people.profiles, config)
    return {r.who: (json.loads(r.json), r.errors) for r in df.join(people.profiles.select("cluster", F.col("full_name").alias("who")), "cluster").select("who", render(df, [f.path for f in config.fields]).alias("json"), "errors").collect()}


def test_projection(people):
    got = shaped(people, [{"path": "a.b", "from": "emails[0]"}, {"path": "a.c", "from": "phones[9]", "on_missing": "omit"}, {"path": "s", "from": "skills[].name", "normalize": "lowercase"}, {"path": "bad", "from": "x..y[q]"}, {"path": "conf", "from": "skills[0]"}])
    ann = got["Ann Lee"][0]
    assert ann["a"] == {"b": "ann@lee.org"} and "python" in ann["s"] and ann["bad"] is None and set(ann["conf"]) == {"name", "sources"}
    assert got["Bo Ray"][0]["a"] == {"b": None}
    must = shaped(people, [{"path": "mail", "from": "emails[0]", "on_missing": "error"}])
    assert must["Ann Lee"][1] == [] and len(must["Bo Ray"][1]) == 1
    full = shaped(people, [{"path": "n", "from": "full_name"}], include_confidence=True, include_provenance=True)["Ann Lee"][0]
    assert list(full) == ["n", "overall_confidence", "provenance"] and {p["field"] for p in full["provenance"]} == {"full_name"}


@pytest.mark.parametrize("bad", [[], {"on_missing": "x"}, {"fields": [{}]}, {"fields": [{"path": "a", "type": "text"}]}, {"fields": [{"path": "a", "on_missing": "drop"}]}, {"fields": [{"path": "a"}, {"path": "a.b"}]}])
def test_config_errors(bad):
    with pytest.raises(ValueError):
        OutputConfig.from_dict(bad)


def test_required_and_types(spark, people):
    from loomfuse.plans.pipeline import shape

    config = OutputConfig.from_dict({"fields": [{"path": "mail", "from": "emails[0]", "type": "string", "required": True}, {"path": "n", "from": "skills[].name", "type": "string[]"}], "include_provenance": False})
    good, bad = shape(people.profiles, config)
    assert {json.loads(r.json)["mail"] for r in good.collect()} == {"ann@lee.org"}
    assert bad.count() == 3
    assert shape(people.profiles, config, validate=False)[0].count() == 4
    wrong, _ = shape(people.profiles, OutputConfig.from_dict({"fields": [{"path": "n", "from": "full_name", "type": "number"}]}))
    assert wrong.count() == 1  # only the profile without a name


def test_ranking(people):
    assert parse_keywords(" Go, k8s;go\n\nMachine   Learning ") == ["Go", "k8s", "Machine Learning"]
    got = {r.full_name: r for r in rank(people.profiles, "k8s, initech, go, java").collect()}
    assert got["Ann Lee"].matched == ["k8s", "initech", "go"]
    assert got["Ann Lee"].score == round(0.6 * 0.75 + 0.4 * got["Ann Lee"].overall_confidence, 4)
    assert rank(people.profiles).first().full_name == "Ann Lee"
    assert keyword_match(people.profiles, []).first().match_fraction == 0.0


def record(pos, source, name=None, emails=(), phones=(), spec=0, **more):
    base = {"spec_idx": spec, "pos": pos, "source": source, "full_name": name, "emails": list(emails), "phones": list(phones), "other_links": [], "skills": [], "experience": [], "education": []}
    return base | more


def test_stream(spark, tmp_path):
    from loomfuse.streaming.incremental import ProfileStore, read_records, write_profiles

    src = tmp_path / "in"
    src.mkdir()
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    for n, name in ((0, "Ann Lee"), (1, "Ann B. Lee"), (2, "Bob Ray")):
        (src / f"{n}.json").write_text(json.dumps(record(n, "ats_json", name, ["a@b.co"] if n < 2 else ["c@d.co"])))
        write_profiles(read_records(spark, str(src)), store, state).awaitTermination()
    assert sorted(r.full_name for r in ProfileStore(spark, store).profiles().collect()) == ["Ann B. Lee", "Bob Ray"]
    assert ProfileStore(spark, store).profiles(0).first().full_name == "Ann Lee"


def all_of(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect())


def test_batches_equal_all_records(spark, tmp_path):
    """Chains that later batches close, roots that move twice, names and phones as links, records without keys, empty batches, repeats."""
    from loomfuse.plans.pipeline import build_profiles
    from loomfuse.sources.schemas import RAW
    from loomfuse.streaming.incremental import ProfileStore

    batches = [
        [record(10, "resume", "Ann Lee", ["a@x.co"], skills=["py"]), record(11, "ats_json", None, ["b@x.co"]), record(12, "ats_json", "Cy Doe", ["c@x.co"], headline="x"), record(13, "recruiter_notes")],
        [],
        [record(5, "recruiter_csv", None, ["a@x.co", "b@x.co"], headline="joins two"), record(20, "ats_json", "Dan Ek", ["d@x.co"])],
        [record(1, "resume", "cy doe", ["B@X.co"]), record(2, "resume", None, [], ["+1 415 555 2671"]), record(3, "ats_json", None, ["e@x.co"], ["(415) 555-2671"])],
        [record(30, "ats_json", "Dan Ek", [], headline="by name"), record(31, "recruiter_notes", spec=2)],
    ]
    store = ProfileStore(spark, str(tmp_path / "store"), buckets=8)
    make = lambda rows: spark.read.schema(RAW).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 1))
    for n, rows in enumerate(batches):
        store.add(make(rows), n)
        if n in (2, 4):
            whole = all_of(build_profiles(make([r for b in batches[: n + 1] for r in b])))
            assert all_of(store.profiles()) == whole, n
    store.add(make(batches[4]), 4)  # a batch once more changes nothing
    assert all_of(store.profiles()) == whole
    # only touched clusters are merged and written
    assert spark.read.parquet(str(tmp_path / "store/profiles/version=4")).count() == 2
    plan = store._read("members", 4, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    again = store.compacted(str(tmp_path / "compact"))
    more = [record(40, "ats_json", None, ["d@x.co", "a@x.co"])]
    again.add(make(more), 1)
    assert all_of(again.profiles()) == all_of(build_profiles(make([r for b in batches for r in b] + more)))


def test_batch_graph_holds_ties_only(spark, tmp_path, monkeypatch):
    """A batch's graph has edges for records that tie two keys, not for all that share one; each bucket of a log is one file here."""
    from loomfuse.sources.schemas import RAW
    from loomfuse.streaming import incremental

    seen, solve = [], incremental.connected_components
    monkeypatch.setattr(incremental, "connected_components", lambda edges: seen.append(edges.count()) or solve(edges))
    make = lambda rows: spark.read.schema(RAW).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 8))
    store = incremental.ProfileStore(spark, str(tmp_path / "store"), buckets=4)
    store.add(make([record(n, "ats_json", None, [f"p{n % 20}@x.co"]) for n in range(200)]), 0)
    store.add(make([record(n, "resume", None, [f"p{n % 20}@x.co"]) for n in range(200, 400)] + [record(400, "resume", None, ["p1@x.co", "p2@x.co"]), record(401, "resume", None, ["p1@x.co"], ["415 555 2671"])]), 1)
    assert seen == [0, 1] and store.profiles().count() == 19
    for version in (0, 1):
        assert len(list((tmp_path / f"store/profiles/version={version}").glob("bucket=*/*.parquet"))) <= 4


def test_random_batches_equal_all_records(spark, tmp_path):
    """Keys that meet in any order, with records smaller than the roots that they join."""
    import random

    from loomfuse.plans.pipeline import build_profiles
    from loomfuse.sources.schemas import RAW
    from loomfuse.streaming.incremental import ProfileStore

    draw = random.Random(5)
    places = draw.sample(range(1000), 120)
    some = lambda: [f"k{draw.randrange(70)}@x.co" for _ in range(draw.choice((0, 1, 1, 1, 2, 3)))]
    rows = [record(p, draw.choice(("ats_json", "resume", "elsewhere", "nowhere")), draw.choice((None, None, f"Nam E{chr(97 + p % 9)}{chr(97 + p % 25)}")), some(), skills=draw.sample(["py", "Go", "weird  skill", "PY"], 2)) for p in places]
    make = lambda part: spark.read.schema(RAW).json(spark.sparkContext.parallelize([json.dumps(r) for r in part], 2))
    store = ProfileStore(spark, str(tmp_path / "store"), buckets=4)
    for n in range(3):
        store.add(make(rows[40 * n : 40 * (n + 1)]), n)
    got = all_of(store.profiles())
    assert got == all_of(build_profiles(make(rows))) and 5 < len(got) < 100


def test_evidence_of_known_and_other_sources(spark):
    from loomfuse.operators.profiles import evidence

    rows = [(1, "skills", "Go", s) for s in ("zeta", "resume", "alpha", "zeta", "ats_json", "resume")] + [(1, "headline", "x", "alpha"), (2, "skills", "Go", "recruiter_csv")]
    got = {(r.cluster, r.path): (r.conf, r.sources, r.source, r.prio) for r in evidence(spark.createDataFrame(rows, "cluster long, path string, value string, source string")).collect()}
    assert got == {
        (1, "skills"): (round(1 - (1 - 0.765) * (1 - 0.8) ** 2 * 0.5**3, 4), ["ats_json", "resume", "alpha", "zeta"], "resume", 2), (1, "headline"): (0.5, ["alpha"], "alpha", 99), (2, "skills"): (0.45, ["recruiter_csv"], "recruiter_csv", 0),
    }


def test_phone_query_takes_whole_texts(spark, tmp_path):
    import re

    from loomfuse.plans.queries import phone_digit_filter

    texts = ["call 9876543210 now", "card 4111 1111 1111 1111 1, id 123456789012345678 and (212) 555-0123, 212-555-0199.", "a1234567 b 20202020x c 555 01 02 03", "no digit", "", None, "7 654 321 0, 7 654 321 0", "x415-555-0100 +34 612 345 678"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pattern = re.compile(r"(?<!\w)(\+?\d[\d\s().\-]{6,}\d)(?!\w)")
    want = {(i, p.strip()) for i, t in enumerate(texts) for p in pattern.findall(t or "") if 7 <= sum(c.isdigit() for c in p) <= 15}
    got = [tuple(r) for r in phone_digit_filter(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {(0, "9876543210"), (1, "212-555-0199"), (7, "+34 612 345 678")} <= want


def test_strict_runs_raise(spark):
    from loomfuse.plans.config import ProjectionError, ValidationError

    source = [Source(type="recruiter_notes", text="Candidate: Ann Lee\nann@lee.org, knows Go")]
    needs = OutputConfig.from_dict({"fields": [{"path": "headline", "on_missing": "error"}]})
    with pytest.raises(ProjectionError, match="headline"):
        run(spark, source, needs, strict=True)
    assert run(spark, source, needs).warnings.count() == 1
    odd = OutputConfig.from_dict({"fields": [{"path": "full_name", "type": "number"}]})
    with pytest.raises(ValidationError, match="expected number"):
        run(spark, source, odd, strict=True)
    assert run(spark, source, strict=True).outputs.count() == 1


def test_command_line(spark, tmp_path, capsys):
    from loomfuse.cli import main

    (tmp_path / "notes.txt").write_text("Candidate: Ann Lee\nann@lee.org, knows Go\n\nCandidate: Bo Ray\nbo@ray.org, knows Rust")
    (tmp_path / "bad.xyz").write_text("")
    assert main(["-s", f"recruiter_notes={tmp_path}/notes.txt", "-s", f"{tmp_path}/bad.xyz", "--keywords", "rust", "-o", str(tmp_path / "out.json")]) == 0
    rows = json.loads((tmp_path / "out.json").read_text())
    assert [r["full_name"] for r in rows] == ["Bo Ray", "Ann Lee"] and "not recognised" in capsys.readouterr().err
    assert main(["-s", f"{tmp_path}/notes.txt", "-q", "--lines", str(tmp_path / "lines")]) == 0
    assert sorted(json.loads(r.value)["full_name"] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["Ann Lee", "Bo Ray"]
    assert main([]) == 2


BITS = ["a", "b c", '"', '""', ",", "\n", "\r\n", "é", "x" * 30, "{", "}", "\\", "[", "]", "漢"]


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "0"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def test_delimited_by_ranges(spark, tmp_path, small_ranges):
    """Quotes, separators and line ends anywhere in fields, over many ranges, against Python's reader."""
    import csv
    import io

    from loomfuse.sources.ranges import delimited_records, pieces, quote_open, quote_states

    r = random.Random(4)
    want = {}
    for k in range(3):
        rows = [["h1", "h2", "h3"]] + [["".join(r.choice(BITS) for _ in range(r.randint(0, 8))) for _ in range(3)] for _ in range(70)]
        b = io.StringIO()
        csv.writer(b, lineterminator=("\n", "\r\n")[k % 2]).writerows(rows)
        (tmp_path / f"{k}.csv").write_text(b.getvalue(), newline="")
        want[f"{k}.csv"] = rows
    records, headers = delimited_records(spark, str(tmp_path))
    got = {}
    for x in records.collect():
        got.setdefault(x.file.split("/")[-1], []).append((x.pos, x.text))
    parse = lambda t: next(csv.reader(io.StringIO(t, newline="")))
    for name, rows in want.items():
        assert [parse(t) for _, t in sorted(got[name])] == rows[1:]
    assert [parse(x.text) for x in headers.collect()] == [["h1", "h2", "h3"]] * 3
    states = quote_states(pieces(spark, str(tmp_path), "\n")).collect()
    assert len(states) > 10 and any(s.inside for s in states) and any(not s.inside for s in states)
    assert [quote_open(x, i) for x, i in ((b'a,"b', False), (b'5" pipe, 6"', False), (b'b""', True), (b'b",c', True), (b'b","', True), (b'"a" x,"', False))] == [True, False, True, False, True, True]


def test_data_source(spark, tmp_path, small_ranges):
    """The data source gives the rows of the function reader, by ranges and by whole files, and only the columns asked for."""
    import csv
    import io

    from loomfuse.sources.datasource import PersonExport, read_export
    from loomfuse.sources.readers import read_delimited

    r = random.Random(9)
    (tmp_path / "in").mkdir()
    for k in range(2):
        b = io.StringIO()
        rows = [[f"Name {i} " + "".join(r.choice(BITS) for _ in range(r.randint(0, 6))), r.choice(["", f"m{i}@x.co"]), "".join(r.choice(BITS) for _ in range(r.randint(0, 40)))] for i in range(60)]
        csv.writer(b).writerows([["Candidate", "E-Mail", "Remarks"], *rows])
        (tmp_path / "in" / f"{k}.csv").write_text(b.getvalue(), newline="")
    want = all_of(read_delimited(spark, str(tmp_path / "in")).drop("pos"))
    got = read_export(spark, str(tmp_path / "in"), str(tmp_path / "states"))
    assert got.rdd.getNumPartitions() > 8 and all_of(got.drop("pos")) == want and got.select("pos").distinct().count() == got.count() == 120
    spark.dataSource.register(PersonExport)
    whole = spark.read.format("person_export").option("columns", "full_name,emails").load(str(tmp_path / "in"))
    assert whole.columns == ["full_name", "emails"] and all_of(whole) == all_of(got.select("full_name", "emails"))


def test_terms_in_one_pass(spark):
    """All terms found by one pattern, as by one for each."""
    import re

    from loomfuse.functions import rules as R
    from loomfuse.functions.text import find_terms
    from loomfuse.sources.readers import scan_skills

    texts = ["spring boot, node.js c++ c++11 c# (react.js)", "Google Cloud Platform; java script_js rest api's", "xpython python3 py3 .NET-core", "", None, "É tf2 tf\ngo-lang go", "natural language processing NLP ml/dl"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    one = lambda t, a: re.search(rf"(?<![A-Za-z0-9]){re.escape(a)}(?![A-Za-z0-9])", t)
    for i, found in df.select("i", scan_skills(F.col("t"))).collect():
        assert (found or []) == [a for a in R.SKILL_SPELLINGS if texts[i] and one(texts[i].lower(), a)]
    terms = [".net", "é", "go", "tf", "c++", "platform; java", "python", "", "api's"]
    for i, found in df.select("i", find_terms(F.lower("t"), terms)).collect():
        assert (found or []) == [a for a in terms if a and texts[i] and one(texts[i].lower(), a)]


def test_json_by_ranges(spark, tmp_path, small_ranges):
    """Objects found over many ranges, whatever strings hold: the wrapping key by priority, single objects, files that are cut, empty or no JSON."""
    from loomfuse.sources.ranges import json_records

    r = random.Random(5)
    text = lambda n: "".join(r.choice(BITS) for _ in range(n))
    obj = lambda d: {text(2): r.choice([1, None, text(6), [{}, [{"q": "}"}]]]) if d else obj(1) for _ in range(r.randint(0, 4))}
    recs, other = [[obj(r.randint(0, 1)) for _ in range(n)] for n in (40, 9)]
    files = {
        "a": (json.dumps([*recs, 5, "x", [{"no": 1}]]), recs), "b": (json.dumps({"meta": {"a": {"b": {}}}, "results": other, "candidates": recs, "n": {"x": [{"z": 1}]}}, indent=2, ensure_ascii=False), recs),
        "c": (json.dumps({"data": recs}) + "\n", recs), "d": (json.dumps(recs[:1]), recs[:1]), "e": ('{"name": "one", "x": [{"y": 1}]}\n', [{"name": "one", "x": [{"y": 1}]}]), "f": ("[]", []), "g": ("", []),
        "cut": (json.dumps(recs)[:-1], []), "cut2": ('{"data": [{"a": 1}\n', []), "cut3": ('[{"a": "b', []), "text": ("hello", []), "bom": ("\ufeff" + json.dumps(recs), recs),
    }
    for name, (t, _) in files.items():
        (tmp_path / f"{name}.json").write_text(t, encoding="utf-8")
    rows, told = json_records(spark, str(tmp_path), ("candidates", "applicants", "results", "data", "records"))
    got = {}
    for x in rows.collect():
        got.setdefault(x.file.split("/")[-1][:-5], []).append((x.pos, x.text))
    for name, (_, w) in files.items():
        assert [json.loads(t) for _, t in sorted(got.get(name, []))] == w, name
    assert {x.file.split("/")[-1][:-5] for x in told.where("error is not null").collect()} == {"cut", "cut2", "cut3", "text"}


def test_sources_in_one_plan(spark, tmp_path):
    """Files and folders of all types, one of them twice, with faults: good rows and warnings by source."""
    from loomfuse.plans.pipeline import extract_all

    (tmp_path / "more files").mkdir()
    (tmp_path / "more files" / "a.csv").write_text("Email,NAME\na@x.co,Ann\n,,\nb@x.co\n")
    (tmp_path / "more files" / "b.csv").write_text("\ufeffcandidate,,mobile\nBob,x,1\n", encoding="utf-8")
    (tmp_path / "bad.csv").write_bytes(b"email\nc@x.co\n\xff\xfe\n")
    (tmp_path / "cut.json").write_text('[{"email": "d@x.co"}')
    (tmp_path / "n.txt").write_text("Name: Eve\ne@x.co\n\nName: Flo\n")
    (tmp_path / "m.txt").write_bytes(b"Name: \xff\n")
    sources = ["more files", "bad.csv", "cut.json", "n.txt", "m.txt", "absent.csv", "more files/a.csv"]
    raw, warnings = extract_all(spark, [Source(str(tmp_path / s), "recruiter_csv" if s == "more files" else None) for s in sources])
    rows = {(r.spec_idx, r.full_name, *r.emails, *r.phones) for r in raw.collect()}
    assert rows == {(0, "Ann", "a@x.co"), (0, None, "b@x.co"), (0, "Bob", "1"), (3, "Eve", "e@x.co"), (3, "Flo"), (6, "Ann", "a@x.co"), (6, None, "b@x.co")}
    assert raw.select("spec_idx", "pos").distinct().count() == raw.count()
    told = {(w.source.split("/")[-1], w.message) for w in warnings.collect()}
    assert told == {("bad.csv", "contributed no records (bad.csv is not UTF-8 text)"), ("cut.json", "contributed no records (cut.json ends inside a value)"), ("m.txt", "contributed no records (m.txt is not UTF-8 text)"), ("absent.csv", "contributed no records (not found)")}
