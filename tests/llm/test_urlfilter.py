import datetime as dt
import random

from pathloom.llm import urlfilter
from tests.llm.cases import clashing

PAGES = "page_id long, url string, fetch_date date"
LIST = "key string, action string, entry_date date"


def day(n):
    return dt.date(2023, 1, 1) + dt.timedelta(n)


def keys(url):
    if url is None or "://" not in url:
        return []
    rest = url.split("://", 1)[1]
    head = rest
    for c in "/?#":
        head = head.split(c)[0]
    host = head.rsplit("@", 1)[-1]
    host = (host.split("]")[0] + "]" if host.startswith("[") else host.split(":")[0]).lower().rstrip(".")
    path = rest[len(head):].split("?")[0].split("#")[0]
    labels, steps = host.split("."), [s for s in path.split("/") if s]
    numbers = host.startswith("[") or all(x.isdigit() for x in labels)
    out = [host] if numbers else [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))]
    return out + [host + "/" + "/".join(steps[:i + 1]) for i in range(len(steps))] if host else []


def brute(pages, entries):
    order = {"block": 2, "allow": 1, "clear": 0}
    out = []
    for p, url, when in pages:
        best = None
        for k in keys(url) if when else []:
            known = {}
            for key, action, d in entries:
                if key == k and d is not None and d <= when:
                    known[d] = max(known.get(d, 0), order.get(action, 0))
            if known and known[max(known)]:
                best = max(best or (0, ""), (len(k), k, known[max(known)]))
        out.append((p, url, when, best[1] if best else None, {2: "block", 1: "allow"}[best[2]] if best else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.url, r.fetch_date, r.matched_key, r.action) for r in df.collect()), key=str)


def case(seed):
    rng = random.Random(seed)
    hosts = ["a.example.com", "b.example.com", "www.a.example.com", "x.org", "example.com", "localhost"]
    pages = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/q', '/q?x=/p', '#p'])}",
              day(rng.randrange(400))) for i in range(150)]
    names = [*hosts, "org", "a.example.com/p", "x.org/p/q", "b.example.com/q"]
    entries = [(rng.choice(names), rng.choice(["block", "allow", "clear"]), day(rng.randrange(-50, 420)))
               for _ in range(60)]
    return pages, entries


def test_equals_looking_up_every_entry(make):
    for seed in range(3):
        pages, entries = case(seed)
        assert got(urlfilter.filter_urls(make(PAGES, pages), make(LIST, entries))) == brute(pages, entries)


def test_intervals_end_where_the_next_begins(make):
    entries = [("x.org", "block", day(1)), ("x.org", "block", day(5)), ("x.org", "clear", day(9)), ("x.org", "allow", day(9)),
               ("x.org", "allow", day(20)), ("x.org", "clear", day(30)), ("x.org", "block", day(40))]
    rows = urlfilter.intervals(make(LIST, entries)).orderBy("valid_from").collect()
    assert [(r.action, r.valid_from, r.valid_to) for r in rows] == [
        ("block", day(1), day(9)), ("allow", day(9), day(30)), ("block", day(40), None)]


def test_odd_rows(make):
    pages, entries = case(5)
    pages += [pages[0], pages[0], (None, "http://x.org/", day(3)), (1, None, day(3)), (2, "http://x.org/", None),
              (3, "", day(1)), (4, "not a url", day(1)), (5, "http://" + "a." * 200 + "example.com/" + "p/" * 200, day(9)),
              (6, "HTTP://U@X.ORG:80/P", day(2)), (7, "http:///p", day(2))]
    entries += [(None, "block", day(1)), ("x.org", "block", None), ("x.org", None, day(2)), ("", "block", day(0)),
                entries[0]]
    pages = [p for p in pages if p[0] != 6]
    a, b = make(PAGES, pages), make(LIST, entries)
    assert got(urlfilter.filter_urls(clashing(a), clashing(b))) == brute(pages, entries)
    assert urlfilter.filter_urls(make(PAGES, []), b).count() == 0
    assert {r.action for r in urlfilter.filter_urls(a, make(LIST, [])).collect()} == {None}


def test_no_form_of_a_host_slips_through(make):
    forms = ["https://evil.com/x", "https://u:p@evil.com/x", "https://u@evil.com/", "https://evil.com./x", "https://EVIL.com:8080",
             "https://a@b@evil.com/q", "ftp://sub.evil.com../y", "https://u:p@evil.com?z=@good.org"]
    others = ["https://good.org/@evil.com", "https://evil.com.good.org/", "https://good.org?u@evil.com", "https://10.0.0.7/", "mailto:x@evil.com",
              "https://evil.com@good.org/", "https://notevil.com", "https://[::1]:80/evil.com"]
    pages = [(i, u, day(5)) for i, u in enumerate(forms + others)] + [(90, "https://7.0.0.10/x", day(5)), (91, "http://[2001:db8::7]:80/", day(5))]
    entries = [(k, "block", day(0)) for k in ("evil.com", "0.7", "0.10", "[2001:db8::7]")]
    out = got(urlfilter.filter_urls(make(PAGES, pages), make(LIST, entries)))
    assert out == brute(pages, entries)
    assert {p for p, *_, action in out if action == "block"} == {*range(len(forms)), 91}
