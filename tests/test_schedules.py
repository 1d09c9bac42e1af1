"""Schedule pages against a plain line-by-line parser."""

import datetime as dt
import random
import re

from touchline.operators import schedules as H

DAY = dt.date(2024, 5, 12)


def noise(x):
    low = x.lower()
    return not x or low in H.NOISE or low.startswith(tuple(H.NOISE_STARTS)) or bool(re.fullmatch(r"\d{1,2}", x))


def on_day(text):
    try:
        return dt.datetime.strptime(text + "2024", "%d.%m.%Y").date() == DAY
    except ValueError:
        return True


def infer(text):
    text = " ".join(text.split())
    for p in H.PAIRS:
        m = re.search(p, text)
        if text and m:
            k, s = re.search(H.KICKOFF, text), re.search(H.SCORE, text)
            return (m[1].strip(" -|"), m[2].strip(" -|"), k[0] if k else None, int(s[1]) if s else None, int(s[2]) if s else None)
    return None


def plain(page):
    lines, out = [x.strip() for x in re.split("\r\n|\n|\r", page)], []
    following = lambda i: next((x for x in lines[i:] if not noise(x)), None)
    for i, x in enumerate(lines):
        m = re.match(r"^(\d{2}\.\d{2}\.)\s+(\d{1,2}:\d{2})$", x)
        if m and on_day(m[1]):
            home, away = following(i + 1), following(i + 2)
            if home and away and home != away:
                out.append((home.strip(" -|"), away.strip(" -|"), m[2], None, None))
    if out:
        return out
    clean = " ".join(page.split())
    parts = re.split(r"(?<!\d)(\d{2}\.\d{2}\.)\s+", clean)
    if len(parts) == 1:
        one = infer(clean)
        return [one] if one else []
    for date, said in zip(parts[1::2], parts[2::2], strict=True):
        if said.strip() and on_day(date):
            out += [f for p in said.strip().replace("Show more", "").strip(" ,;").split(",") if p.strip() and (f := infer(p.strip()))]
    return out


PAGES = [
    "Football\n12.05. 18:00\nAjax\nLeeds |\n2\n12.05. 20:15\nAdvertisement\nInter\nMilan\n13.05. 18:00\nPorto\nLyon\n99.99. 9:30\nReal - \n\nROUND 3\nshow more\nCelta",
    "12.05. 18:00 Ajax v Leeds 2-1, Inter vs. Milan LIVE ,, nothing here, Porto - Lyon 20:30 Show more 13.05. 18:00 X v Y 12.05. Real versus Celta; 45.13. A - B 0-0",
    "Ajax v Leeds 19:45 3 - 1", "Ajax - Leeds 4:2", "no fixture at all", "", "   \n\t", "12.05. 18:00\nAjax\nAjax", "12.05. 18:00\nAjax", "12.05. ", "112.05. A v B", "12.05. 18:00\r\nAjax\r\nForm\r\n7\r\nLeeds\r12.05. 18:30\rA\rB",
]


def test_pages(spark):
    r, pages = random.Random(3), list(PAGES)
    bits = ["12.05. 18:00", "13.05. 19:00", "Ajax", "Leeds", " - Inter |", "Round 2", "7", "", "Advertisement", "Standings", "Milan v Porto 2-0", "33.05. 9:00", "12.05. Ajax v Lyon, A - B 1:0"]
    pages += [r.choice(["\n", "\n", "\r\n"]).join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(400)]
    df = spark.createDataFrame([(k, p, DAY) for k, p in enumerate(pages)] + [(-1, None, DAY), (-2, "A v B", None)], "id int, page string, day date")
    got = {}
    for x in H.parse_schedules(df, ["id"], "page", "day").collect():
        got.setdefault(x.id, []).append(tuple(x)[1:])
    want = {k: f for k, p in enumerate(pages) if (f := plain(p))}
    assert {k: got.get(k) for k in want} == want and got.keys() == want.keys()
    assert len(want[0]) == 2 and len(want[1]) > 3


def test_a_long_page(spark):
    page = "\n".join(f"12.05. 18:{k % 60:02}\nHome {k}\nForm\nAway {k}" for k in range(20_000))
    df = spark.createDataFrame([(page, DAY)], "page string, day date")
    assert H.parse_schedules(df, [], "page", "day").count() == 20_000
