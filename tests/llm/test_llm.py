"""Operators of the llm subpackage: cases, edges, brute force and held-out truth."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("sightline.llm")

from sightline.llm.encoding import Encoded, cuts, encode_corpus, encoder, join_all, join_tokens
from sightline.llm.linkage import LabelModel, link
from sightline.llm.names import Profiles, abbreviates, core, resolve_names
from sightline.llm.packing import pack, plan
from sightline.llm.places import map_countries, map_places
from sightline.llm.residue import CASED, FORMS, detector, find_residue
from sightline.llm.spelling import LongVocabulary, Vocabulary, deletions, distance, fold
from sightline.llm.survivors import consensus, group_consensus, survivors
from sightline.llm.titles import TitleWords

PIECES = ["a", " ", "  ", "\n", "'ll", "'s", "'", "é", "مر", "1", "23", "!?", "\t", "don't ", "the ", "aaaa", "한", "🎉", "ab", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.sampled_from([1, 2, 3, 5, 8, 13, 40]))
def test_tree_concatenation_is_exact(parts, leaf):
    enc, text = encoder(), "".join(parts)
    leaves = [Encoded.of(enc, text[i : i + leaf]) for i in range(0, len(text), leaf)]
    assert join_all(enc, leaves).ids() == enc.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "word", " word", "م ر", "x y z "]), max_size=60), st.sampled_from([8, 16, 40]))
def test_certain_borders_are_borders(parts, leaf):
    enc, text = encoder(), "".join(parts)
    ids, run, at = [], "", 0
    for end, certain in cuts(text, leaf):
        run, at = run + text[at:end], end
        if certain:
            ids, run = ids + enc.encode_ordinary(run), ""
    assert at == len(text) and ids == enc.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdehilnorstw", min_size=1, max_size=80), st.integers(0, 80))
def test_joined_tokens_are_exact(word, at):
    enc, at = encoder(), min(at, len(word))
    left, right = (enc._encode_single_piece(x.encode()) if x else [] for x in (word[:at], word[at:]))
    assert join_tokens(enc, left, right) == enc._encode_single_piece(word.encode())


def test_encoding_of_a_corpus(spark):
    texts = {1: "plain text", 2: None, 3: "", 4: "a" * 30000, 5: "word " * 9000, 6: "<|endoftext|> stays", 7: "م" * 20000}
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in texts.items()] + [(1, "plain text", 0, "x")], "doc_id long, text string, k int, ids string")
    got = [(r["doc_id"], r["ids"]) for r in encode_corpus(df, "doc_id", "text").collect()]
    assert len(got) == 8
    for k, ids in got:
        assert ids == encoder().encode_ordinary(texts[k] or "")
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_plans_use_up_the_histogram(histogram):
    used = Counter()
    for shape, n in plan(histogram, 50):
        assert sum(shape) <= 50 and n > 0
        for k in shape:
            used[k] += n
    assert used == Counter(histogram)


def test_packing(spark):
    random.seed(3)
    sizes = [(i, random.choice([0, 5, 30, 70, 99, 100, 101, 250, 301])) for i in range(400)] + [(7, 30), (500, None)]
    df = spark.createDataFrame(sizes, "doc_id long, n int")
    rows = pack(df, "doc_id", "n", [("s", 100), ("l", 300)]).collect()
    for kind, cap in (("s", 100), ("l", 300)):
        mine = [r for r in rows if r["container_kind"] == kind]
        assert Counter({k: sum(r["tokens"] for r in mine if r["doc_id"] == k) for k in {r["doc_id"] for r in mine}}) == Counter({k: sum(n or 0 for j, n in sizes if j == k) for k, _ in sizes})
        fill = Counter()
        for r in mine:
            fill[r["container_id"]] += r["tokens"]
            assert (r["container_id"] is None) == (r["tokens"] == 0)
        assert max(v for k, v in fill.items() if k) <= cap
        split = Counter(r["doc_id"] for r in mine)
        assert all(split[k] == 1 for k, n in sizes if (n or 0) <= cap and k != 7)
        assert sum(fill.values()) / (cap * (len(fill) - 1)) > 0.9
    assert pack(df.limit(0), "doc_id", "n", [("s", 100)]).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=6), st.text(alphabet="abc", max_size=6))
def test_distance_and_deletion_keys(a, b):
    d = distance(a, b, 9)
    assert d == distance(b, a, 9) and (d == 0) == (a == b) and d <= max(len(a), len(b))
    assert distance(a, b, 1) == min(d, 2)
    if d <= 1:
        assert deletions(a) & deletions(b)


def test_spellings():
    assert fold("باغاتام") == fold("baghatam") and fold("fooritrit") == fold("furitrit")
    assert Vocabulary({"kutufim", "kifafak"}).near("ktufim")[0][0] == "kutufim"
    assert abbreviates("svcs", "services") and abbreviates("mgmt", "management") and not abbreviates("services", "services")


PLACES = [("al firatrat", "Al Firatrat", "Fimarut"), ("firatrat", "Al Firatrat", "Fimarut"), ("jabal kutufim", "Jabal Kutufim", "Labikbas"), ("umm fufanil", "Umm Fufanil", "Ranubuq"), ("nibamaq", "Nibamaq", "Muramin"), ("fimarut region", None, "Fimarut")]


def test_places(spark):
    mapping = spark.createDataFrame(PLACES, "alias string, city_std string, region_std string")
    want = {"AL FRIATRAT": "Al Firatrat", "A1 Firatrat, Fimarut Region, Saudi Arabia": "Al Firatrat", "J. Ktufim (On-site)": "Jabal Kutufim", "U. Fufanil": "Umm Fufanil", "جبل كوتوفيم، السعودية": "Jabal Kutufim", "Nibamaq & Umm Fufanil": "UNMATCHED", "Nibaaq": "Nibamaq", "Fimrut Prov.": "Fimarut", "Berlin, Germany": "UNMATCHED", "12345": "UNMATCHED", "jabalkutufim": "Jabal Kutufim"}
    want["x " * 3000 + "Nibamaq"] = "Nibamaq"
    df = spark.createDataFrame([(v, "", "") for v in [*want, *want, None, "", "  "]], "v string, t string, tokens string")
    assert {r["v"]: r["canonical"] for r in map_places(df, "v", mapping).collect()} == want
    assert map_places(df.limit(0), "v", mapping).count() == 0


def test_countries(spark):
    lands = spark.createDataFrame([("SA", "Saudi Arabia"), ("KR", "South Korea"), ("US", "United States"), ("AU", "Australia"), ("OM", "Oman")], "country_code string, country_name string")
    want = {"K.S.A.": "Saudi Arabia", "Sauui  Ahrabia": "Saudi Arabia", "Arabie-saoudite": "Saudi Arabia", "Souh Korrea": "South Korea", "North Korea": "UNMATCHED", "Unied Stateus": "United States", "Austria": "UNMATCHED", "عمان": "Oman", "Worldwide": "UNMATCHED", "us": "United States"}
    got = map_countries(spark.createDataFrame([(v,) for v in [*want, None, " "]], "v string"), "v", lands)
    assert {r["v"]: r["canonical"] for r in got.collect()} == want


ALIASES = [("furitrit paints and coatings", "Furitrit Paints and Coatings Co."), ("jajosham optics", "Jajosham Optics"), ("jajosham auto parts", "Jajosham Auto Parts Ltd."), ("al dusumul logistics", "Al Dusumul Logistics"), ("naduhos human resources", "Naduhos Human Resources"), ("ناجالول للمقاولات", "Najalul Contracting"), ("private", "Unknown")]


def test_names(spark):
    aliases = spark.createDataFrame(ALIASES, "alias string, company_std string")
    want = {
        "FURITRIT PAINTS + COATINGS": "Furitrit Paints and Coatings Co.", "Paints & Coatings - Furhitrit (Branch 2)": "Furitrit Paints and Coatings Co.", "M/S Fooritrit Paints and Coat. LLC": "Furitrit Paints and Coatings Co.", "jajosham_optics": "Jajosham Optics", "AlDusumul Logist., W.L.L.": "Al Dusumul Logistics",
        "naduhoshumanresources": "Naduhos Human Resources", "N.H.R.": "Naduhos Human Resources", "NHR Ltd": "Naduhos Human Resources", "مؤسسة ناجالول للمقاولات - وظائف": "Najalul Contracting", "Jajosham Trading": None, "Jajosham": None, "Private": None, "A leading group": None, "furitrit paints and coatings": None, "": None, None: None,
    }
    rows = [(str(i), n, "") for i, n in enumerate(want)] + [("0", next(iter(want)), ""), ("d", "Jajosham", "Jajosham Auto Parts needs a buyer.")]
    got = {r["source_record_sk"]: r["company_std"] for r in resolve_names(spark.createDataFrame(rows, "source_record_sk string, company_name string, t string"), "source_record_sk", "company_name", aliases, "t").collect()}
    assert got == {str(i): s for i, s in enumerate(want.values()) if s} | {"d": "Jajosham Auto Parts Ltd."}
    assert core("The Foo Co. L.L.C. - Careers page") == ["foo"] and Profiles([]).match("x")[0] == "none"


def test_merged_spellings_match_further_ones(spark):
    aliases = spark.createDataFrame([("mabijis marine services", "Mabijis Marine Services")], "alias string, company_std string")
    rows = [("1", "Mabijas Marine Services"), ("2", "Mabejas Marine Svcs"), ("3", "Mabejas Dental Clinics")]
    got = {r[0]: r[1] for r in resolve_names(spark.createDataFrame(rows, "k string, n string"), "k", "n", aliases).collect()}
    assert got.get("1") and got.get("2") and "3" not in got


def test_rematch_decides_and_unites_initials(spark):
    """Profiles begin with exact spellings: typos are found by blocking alone, further ones and initials by what was merged."""
    aliases = spark.createDataFrame([("mabijis marine services", "Mabijis Marine Services"), ("al dusumul logistics", "Al Dusumul Logistics"), ("yahosan textiles", "Yahosan Textiles"), ("sahosmas furniture", "Sahosmas Furniture")], "alias string, company_std string")
    rows = [("1", "MABIJIS Marine Services Ltd"), ("2", "Mabijas Marine Services"), ("3", "Mabejas Marine Svcs"), ("4", "AL DUSUMUL LOGISTICS"), ("5", "A.D.L."), ("6", "Sahosas Furniture"), ("7", "Yahosan Furniture")]
    found = lambda **how: {r[0]: r[1] for r in resolve_names(spark.createDataFrame(rows, "k string, n string"), "k", "n", aliases, **how).collect()}
    marine, dusumul = "Mabijis Marine Services", "Al Dusumul Logistics"
    assert found(rematch=False) == {"1": marine, "4": dusumul}
    assert found() == {"1": marine, "2": marine, "3": marine, "4": dusumul, "5": dusumul, "6": "Sahosmas Furniture"}


def test_glued_names_with_two_typos(spark):
    rnd = random.Random(1)
    stems, lines = ["mabijis", "jajosham", "lulittaq", "kiritan", "sanum", "kutufim"], ["marineservices", "autoparts", "dental", "realestate", "x"]
    entries = {a + b for a in stems for b in lines}
    whole, halved = Vocabulary(entries), LongVocabulary(entries)
    for _ in range(3000):
        w = rnd.choice(sorted(entries))
        for _ in range(rnd.randint(0, 3)):
            i, c = rnd.randrange(len(w)), rnd.choice("aeimst")
            w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])
        assert halved.near(w) == whole.near(w), w
    aliases = spark.createDataFrame([("mabijis marine services", "Mabijis Marine Services"), ("jajosham auto parts", "Jajosham Auto Parts")], "alias string, company_std string")
    rows = [("1", "Mabijsmarineservces"), ("2", "Jajoshmaautopatrs"), ("3", "Jajsmautopatrs")]
    assert {r[0]: r[1] for r in resolve_names(spark.createDataFrame(rows, "k string, n string"), "k", "n", aliases).collect()} == {"1": "Mabijis Marine Services", "2": "Jajosham Auto Parts"}


def test_consensus_and_survivors(spark):
    full = "acme needs a buyer for night shift you compare offers from vendors"
    assert consensus([("acme needs a buyer", 1.0), (full, 0.2), ("needs a buyer for nig", 1.0)])[0] == full
    assert consensus([("eds a buyer for night", 5.0), (full, 0.2)])[0] == full
    many = spark.createDataFrame([("g", full[: 12 + i], 1.0) for i in range(len(full) - 11)] + [("h", "x", 1.0)], "g string, t string, w double")
    assert {r["g"]: r["consensus"] for r in group_consensus(many).collect()} == {"g": full, "h": "x"}
    listings = spark.createDataFrame(
        [
            ("a", "workable.example", "Acme needs a buyer for nig", "Negotiable", "N/A", None, "2026-01-01", 9), ("b", " JOOBLE", "<p>Acme needs a buyer for night shift.</p>", "SAR 5000", "Contract", "2026-01-05", "2026-01-02", 1),
            ("c", "jooble", None, None, None, None, "2026-01-03", 1), ("c", "jooble", None, None, None, None, "2026-01-03", 1), ("z", None, "-", None, "TBD", None, None, 1),
        ],
        "source_record_sk string, source_name string, description_text string, salary_text string, employment_type string, posting_date string, last_seen_at string, n int",
    )
    groups = spark.createDataFrame([("j", "a"), ("j", "b"), ("j", "b"), ("j", "c"), ("solo", "a"), ("k", "c"), ("k", "z"), (None, "a")], "job_sk string, source_record_sk string")
    sources = spark.createDataFrame([("workable", 1), ("jooble", 6)], "source_name string, source_priority int")
    got = {(r[0], r[1]): r[2] for r in survivors(listings, groups, sources).collect()}
    assert got == {("j", "record"): "a", ("j", "description_text"): "b", ("j", "salary_text"): "b", ("j", "employment_type"): "b", ("j", "posting_date"): "b", ("k", "record"): "c"}
    assert survivors(listings.limit(0), groups, sources).count() == 0


def test_consensus_decides_which_text_is_full(spark):
    """An excerpt of a trusted source may end as a text does; only the consensus tells it from the full one."""
    full = "Acme needs a buyer for night shift. You compare the offers of vendors."
    rows = [("a", "workable", "Acme needs a buyer for night shift.", "2026-01-01"), ("b", "jooble", full, "2026-01-02"), ("c", "jooble", "...me needs a buyer for night shift. You compare the off", "2026-01-03")]
    listings = spark.createDataFrame([(k, s, t, None, None, None, at) for k, s, t, at in rows], "source_record_sk string, source_name string, description_text string, salary_text string, employment_type string, posting_date string, last_seen_at string")
    groups = spark.createDataFrame([("j", k) for k in "abc"], "job_sk string, source_record_sk string")
    sources = spark.createDataFrame([("workable", 1), ("jooble", 6)], "source_name string, source_priority int")
    chosen = lambda **how: {r[2] for r in survivors(listings, groups, sources, **how).collect() if r[1] == "description_text"}
    assert chosen() == {"b"} and chosen(closeness=0.0) == {"a"}


def test_residue(spark):
    bad = ["Apply to {{company_name}} now", "Position: [اسم الشركة]", "Dear %JOB_TITLE%,", "Reports to: undefined", "Lorem ipsum dolor sit amet", "blah blah blah etc.", "Join us.\nAccess denied. Reference: 1a", "404 Not Found", "Please enable JavaScript to view this page.", "Scripting must be enabled to apply", "Start: &lt;start date&gt;", "Traceback (most recent call last):", "Session timed out, reload the page.", "ok " * 9000 + "$startDate$"]
    good = ["Strong JavaScript is required; we enable JavaScript teams to ship weekly.", "You test the null hypothesis.", "[Full-time] [On-site] Grade <9> role, 9% travel, ref #9.", "Server errors must be logged; a page not found must never reach the customer.", "The budget line $9k and the C++ {fmt} library", "<p>Plain <b>markup</b></p>", "Logs keep <|endoftext|> as plain text.", "", None, "  "]
    rows = [(i, t, None) for i, t in enumerate(bad)] + [(100 + i, t, "h") for i, t in enumerate(good)] + [(0, bad[0], None)]
    rows += [(1000 + i, f"Job {i}.\nPlease enable JavaScript to view this page.", "site") for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r["doc_id"] for r in find_residue(df, "doc_id", "text", "source").collect()]
    assert sorted(got) == list(range(len(bad)))
    assert find_residue(df.limit(0), "doc_id", "text", "source").count() == 0


def test_boilerplate_is_counted_by_documents(spark):
    own = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "theta", "lambda", "zeta"]
    text = lambda i: f"The {own[i % 10]} crew {own[i // 10]} ships weekly."
    rows = [(0, "\n".join(f"Item {i}: [insert text here]" for i in range(10)), "numbered")] + [(i, text(i), "numbered") for i in range(1, 20)]
    rows += [(100, f"{text(0)}\n[insert text here]", "repeated")] * 25 + [(100 + i, text(i), "repeated") for i in range(1, 20)]
    rows += [(200 + i, f"Access denied. Reference: {i}ab{i}\nBack to home" if i % 2 else text(i), "blocked") for i in range(40)]
    rows += [(300 + i, f"{text(i)}\nPlease enable JavaScript to view this page.", "notice") for i in range(25)]
    got = [r["doc_id"] for r in find_residue(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()]
    assert sorted(got) == [0, 100, *range(201, 240, 2)]


def written(tree, rnd, groups):
    """A random text of a parsed expression, repeats as few as may be or one more."""
    out = ""
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN" if str(arg[0][0]) == "NEGATE":
                out += rnd.choice([c for c in "q -" if ("LITERAL", ord(c)) not in [(str(o), a) for o, a in arg]])
            case "IN":
                op, arg = rnd.choice(arg)
                kinds = {"CATEGORY_WORD": "q7", "CATEGORY_DIGIT": "4", "CATEGORY_SPACE": " ", "CATEGORY_NOT_WORD": "! ", "CATEGORY_NOT_SPACE": "q7"}
                out += {"LITERAL": lambda: chr(arg), "RANGE": lambda: chr(rnd.randint(*arg)), "CATEGORY": lambda: rnd.choice(kinds[str(arg)])}[str(op)]()
            case "NOT_LITERAL":
                out += rnd.choice([c for c in "q -" if ord(c) != arg])
            case "ANY":
                out += rnd.choice("q ")
            case "BRANCH":
                out += written(rnd.choice(arg[1]), rnd, groups)
            case "SUBPATTERN":
                out += (text := written(arg[3], rnd, groups))
                groups[arg[0]] = text
            case "GROUPREF":
                out += groups[arg]
            case "MAX_REPEAT":
                out += "".join(written(arg[2], rnd, groups) for _ in range(rnd.randint(arg[0], min(arg[1], arg[0] + 1))))
    return out


@pytest.mark.parametrize("kind", FORMS)
def test_every_form_of_evidence_holds_a_trigger(kind):
    rnd = random.Random(1)
    cased = CASED if kind == "placeholder" else []
    for triggers, form in FORMS[kind] + cased:
        whole = re.compile(form)
        tree = re._parser.parse(form)
        texts = [t for t in (written(tree, rnd, {}) for _ in range(1500)) if whole.search(t)]
        assert texts, form
        missed = [t for t in texts if not any(x in t.lower() for x in triggers)]
        assert not missed, (form, missed[:3])


# Wordings that stood in no table and no form when the forms were written.
HELD_OUT = [
    "Sorry, the vacancy you requested cannot be displayed.", "This listing has expired.", "HTTP ERROR 502 - Bad Gateway", "The server is temporarily unavailable, please try again later.", "Your session has timed out. Please sign in again.", "We were unable to load this page.", "Oops! That page doesn't exist.",
    "You are not authorized to view this page.", "The requested URL was not found on this server.", "504 Gateway Timeout", "Prove you are not a robot to continue", "TypeError: Cannot read properties of undefined", "SQLSTATE[HY000] [2002] Connection refused", "Our site is down for planned maintenance.", "Cette offre n'existe plus.",
    "Diese Seite existiert nicht mehr.", "Der Dienst ist derzeit nicht erreichbar.", "تعذر تحميل الصفحة، حاول مرة أخرى", "Please turn on JavaScript to continue.", "You need to enable JavaScript to run this app.", "To see open roles, please activate scripts in your browser.", "Veuillez autoriser JavaScript pour afficher cette page",
    "Scripts need to be allowed before the form opens.", "Dear {{candidate.first}},", "Join <%= employer %> in %CITY_NAME%", "Start: {start_date}", "Salary: undefined", "(please add benefits)", "[Gehalt ergänzen]", "__HIRING_MANAGER__ will call you", "Reports to <reporting manager>", "Write a short summary here", "Describe the duties below",
    "List the requirements, one per line", "dolor sit amet consectetur adipiscing elit sed", "foo foo foo foo", "qwerty qwerty asdfgh", "This is placeholder text.", "TODO: describe the role", "Hier die Stellenbeschreibung einfügen", "Saisir la description du poste ici", "اكتب الوصف هنا", "The database connection could not be established.",
]
TALK = [
    "Our help desk resolves session timeouts and access denied tickets.", "Reports of pages that cannot be found must be closed within a day.", "The team maintains the JavaScript build and keeps cookies secure.", "Experience with HTTP 404 and 503 handling is a plus.", "Accounts are blocked after three tries.", "Candidates whose visa has expired must tell us.",
    "Know-how in ETL: {json}, <xml> and C#.", "Applicants should describe their duties below 200 words.", "Monitor servers that are not responding and restart them.", "Fix broken links so that no page is ever not found.", "Sie beheben Fehler im Shop, wenn eine Seite nicht erreichbar ist.", "Vous traitez les tickets quand un service est indisponible.",
    "Access to the server room is restricted to badge holders.", "Enable JavaScript developers to release twice a day.", "Very good English, very good Arabic, very good manners.", "Here you write history: join the add-on team.", "Job type: none of the shifts is at night.", "Store keeper needed at gate 12/3.", "Ship nginx/1.25.3 upgrades to all regions every month.",
]


def test_held_out_wordings():
    found = [t for t in HELD_OUT if any(e for _, e in detector().read(t)[0]) or detector().read(t)[1]]
    assert len(found) >= 0.99 * len(HELD_OUT), set(HELD_OUT) - set(found)
    assert not [t for t in TALK if any(e for _, e in detector().read(t)[0])]


def test_subtracting_boilerplate_decides(spark):
    """Without the counts by host the footer's notice would report every document of the site."""
    rows = [(i, f"Job {i} of the crew\nPlease enable JavaScript to view this page.", "site") for i in range(40)] + [(50, "Other job\nPlease enable JavaScript to view this page.", "elsewhere"), (51, "Crew job\nPlease enable JavaScript to view this page.\nJoin {{city}}", "site")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    with_counts = {r["doc_id"] for r in find_residue(df, "doc_id", "text", "source").collect()}
    without = {r["doc_id"] for r in find_residue(df, "doc_id", "text", "source", share=2.0).collect()}
    assert with_counts == {50, 51} and without == {*range(40), 50, 51}


def test_filler_without_its_best_known_words(spark):
    bad = ["Ullamco veniam veniam minim consectetur enim ullamco tempor do.", "sit ut et do sit.", "uiop uiop", "Department:none", "410:gone", "<title>Gateway</title>"]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(bad)], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in find_residue(df, "doc_id", "text", "source").collect()) == list(range(len(bad)))


def test_titles():
    words = TitleWords({w: 100 for w in ["welding", "supervisor", "heritage", "sites", "data", "buyer", "night", "shift", "contracts"]} | {"super": 20, "visor": 20, "heritagesites": 5}, {"jabal", "kutufim"})
    same = ["Junior Welding Supervisor - Heritage Sites", "HERITAGESITES: WELDING SUPER VISOR (Jnr)", "Urgent: Welding Supervisor, Jr. - Heritage Sites - Jabal Kutufim [5608]"]
    assert len({str(words.read(t)) for t in same}) == 1
    assert words.read("Data Buyer II") != words.read("Data Buyer") and words.read("Data Buyer II") == words.read("data buyer, grade 2") and words.read("") == ([], [])


def test_label_model_learns_accuracies():
    random.seed(1)
    accuracy, counts, truth = [0.95, 0.9, 0.55], Counter(), {}
    for _ in range(5000):
        y = random.random() < 0.4
        v = tuple((1 if (random.random() < a) == y else -1) if random.random() < 0.9 else 0 for a in accuracy)
        counts[v] += 1
        truth.setdefault(v, Counter())[y] += 1
    model = LabelModel().fit(dict(counts))
    right = sum(max(c.values()) if (model.posterior(v) > 0.5) == (c[True] > c[False]) else min(c.values()) for v, c in truth.items())
    best = sum(max(c.values()) for c in truth.values())
    assert right >= 0.99 * best and abs(model.prior - 0.4) < 0.1 and LabelModel().fit({}).posterior(()) == 0.5


def test_kinds_of_non_matches():
    """Other employers on the same level are no match, though most pairs of a block differ in level alone."""
    counts = {(1, 1, 1): 500.0, (1, -1, -1): 1500.0, (1, 1, -1): 60.0, (-1, -1, -1): 60.0, (-1, 1, -1): 30.0, (0, 1, 1): 40.0}
    one, kinds = LabelModel().fit(counts), LabelModel((0, 1)).fit(counts)
    assert one.posterior((-1, 1, -1)) > kinds.posterior((-1, 1, -1)) and kinds.posterior((-1, 1, -1)) < 0.5
    assert kinds.posterior((1, 1, 1)) > 0.95 and kinds.posterior((0, 1, 1)) > 0.9 and kinds.posterior((1, -1, -1)) < 0.05
    assert LabelModel((0, 1)).fit({(1, 1, 1): 1000.0}).prior < 1


def test_every_veiled_text_votes(spark):
    works = ["Welding Supervisor", "Fleet Buyer", "Payroll Planner", "Cloud Engineer", "Customs Auditor", "Solar Estimator", "Warehouse Trainer", "Lighting Designer"]
    rows, want, day = [], set(), {"Jajo": "2026-01-05", "Mabi": "2026-03-09", "Crew": "2026-05-20"}
    for i, work in enumerate(works):
        for name, does in (("Jajosham", "you compare the offers of all vendors and keep the long register of items up to date"), ("Mabikolu", "close open points within nine working days and walk the site with the yard crew")):
            text = f"{name} needs a {work} for the yard. {does}"
            rows += [(f"{i}{name}n", "jooble", work, "Riyadh", f"{name} Trading", text), (f"{i}{name}v", "workable", work, "Riyadh", "Confidential", text)]
            want.add((f"{i}{name}n", f"{i}{name}v"))
        hidden = f"Crews meet at dawn beside gate number four and share one lift to the remote {work} camp"
        rows += [(f"{i}x", "jooble", work, None, None, hidden), (f"{i}y", "workable", work, None, "Confidential", hidden), (f"{i}z", "workable", work, None, None, f"Jajosham needs a {work} for the yard. you compare the offers of all vendors and keep the long re")]
        want |= {(f"{i}x", f"{i}y"), (f"{i}Jajoshamn", f"{i}z")}
    listings = spark.createDataFrame([(*r, None, day[r[5][:4]]) for r in rows], "source_record_sk string, source_name string, job_title string, location_raw string, company_name string, description_text string, title_norm string, posting_date string")
    listings = listings.withColumn("posting_date", F.to_date("posting_date")).withColumn("city_std", F.lit(None).cast("string"))
    mapping = spark.createDataFrame([("riyadh", "Riyadh", "Riyadh Region")], "alias string, city_std string, region_std string")
    aliases = spark.createDataFrame([("jajosham trading", "Jajosham Trading"), ("mabikolu trading", "Mabikolu Trading"), ("confidential", "Unknown")], "alias string, company_std string")
    got = {(r[0], r[1]) for r in link(listings, mapping, aliases).collect()}
    assert got == want


def test_linkage_against_known_groups(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    known = t("int_jobs_matched").select("source_record_sk", "job_sk").distinct()
    rows = t("int_job_listings").join(known.select("source_record_sk"), "source_record_sk", "left_semi").withColumn("x", F.lit(1)).withColumn("c", F.lit("clash"))
    got = {(r["listing_a"], r["listing_b"]) for r in link(rows.unionByName(rows.limit(20)), t("seed_city_mapping"), t("seed_company_aliases")).collect()}
    job = {r[0]: r[1] for r in known.collect()}
    source = {r[0]: r[1].strip().lower().removesuffix(".example") for r in rows.select("source_record_sk", "source_name").collect()}
    keys = sorted(source)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if job[a] == job[b] and source[a] != source[b]}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.95 * len(got)
    assert link(rows.limit(0), t("seed_city_mapping"), t("seed_company_aliases")).count() == 0
