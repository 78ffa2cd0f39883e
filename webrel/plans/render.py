"""Rendered inputs: deterministic HTML built by column expressions over the
driver tables (test support for operators whose tags the captured pages lack).

Every renderer emits ``(page_id, url, html)``.  Pages that gather several
source rows (team pages) take a bounded bucket of ``BUCKET`` rows, so no page
grows with the table; the rest are one page per source row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrel.operators.dom import dom_partitions

BUCKET = 20


def esc(c: Column) -> Column:
    """Escape text for HTML (&amp; &lt; &gt; &quot;)."""
    return F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")),
                                         F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")),
                     F.lit('"'), F.lit("&quot;"))


def L(s: str) -> Column:
    return F.lit(s)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small file over all tasks: a payload costs far more than the row it is made from,
    and a file of a few MB is read by one task."""
    return rows.repartition(dom_partitions(rows.sparkSession))


def money(c: Column) -> Column:
    return F.concat(L("$"), F.format_string("%.2f", c))


def part_pages(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    name, brand, typ = esc(F.col("p_name")), esc(F.col("p_brand")), esc(F.col("p_type"))
    size = F.col("p_size").cast("string")
    price = money(F.col("p_retailprice"))
    ld = F.concat(L('{"@type": "Product", "name": "'), name, L('", "sku": '), k.cast("string"),
                  L(', "brand": "'), brand, L('"'), F.when(k % 10 == 0, L("")).otherwise(L("}")))
    price_block = F.when(
        k % 7 == 0, F.concat(L('<div id="fee-box"><h2>Fee</h2><p>'), price, L(" one-time</p></div>"))
    ).otherwise(F.concat(L('<div class="price-card"><h2 class="title">'), brand,
                         L('</h2><span class="amount">'), price, L("</span> per month</div>")))
    img_attr = F.when(k % 3 == 0, L("src")).when(k % 3 == 1, L("data-src")).otherwise(L("data-lazy-src"))
    social = (F.when(k % 4 == 0, F.concat(L('<a href="https://www.facebook.com/'), brand, L('">Facebook</a>')))
              .when(k % 4 == 1, F.concat(L('<a href="https://twitter.com/'), brand, L('">Twitter <b>'), brand,
                                         L("</b></a>")))
              .when(k % 4 == 2, F.concat(L('<a href="https://www.netflix.com/'), brand, L('">Watch</a>')))
              .otherwise(L("")))
    html = F.concat(
        L('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>'), name, L("</title>"),
        L('<meta name="description" content="'), typ, L(' part">'),
        L('<meta property="og:title" content="'), name, L('">'),
        L('<meta property="og:image" content="https://cdn.example.com/'), k.cast("string"), L('.jpg">'),
        L('<link rel="canonical" href="https://shop.example.com/part/'), k.cast("string"), L('">'),
        L('<script type="application/ld+json">'), ld, L("</script></head><body>"),
        L('<nav class="menu"><a href="/">Home</a><a href="/parts">Parts</a></nav><main><h1>'), name, L("</h1>"),
        price_block,
        L('<div class="product-feature"><h3>'), typ, L("</h3><p>Size "), size, L(" "), name,
        L(" for everyday work</p></div>"),
        L("<table><thead><tr><th>Brand</th><th>Type</th><th>Size</th></tr></thead><tbody><tr><td>"), brand,
        L("</td><td>"), typ, L("</td><td>"), size, L("</td></tr></tbody></table>"),
        L('<form action="/cart/'), k.cast("string"),
        L('" method="post"><input type="number" name="qty" placeholder="Quantity">'
          '<input type="hidden" name="sku"><textarea name="note" placeholder="Note"></textarea></form>'),
        L('<button class="btn">Add to cart</button><img '), img_attr, L('="/img/'), k.cast("string"),
        L('.jpg" alt="'), name, L('">'), social,
        L("</main><footer>Parts &amp; more</footer></body></html>"))
    return spread(part).select(k.alias("page_id"), F.concat(L("https://shop.example.com/part/"), k.cast("string")).alias("url"),
                       html.alias("html"))


def supplier_pages(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    s = supplier.join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    k = F.col("s_suppkey")
    name, nat = esc(F.col("s_name")), esc(F.coalesce(F.col("n_name"), L("")))
    es = k % 2 == 1
    dl = F.concat(L("<dl><dt>"), F.when(es, L("Sede")).otherwise(L("Headquarters")), L("</dt><dd>"), nat,
                  L("</dd><dt>"), F.when(es, L("Fundada")).otherwise(L("Founded")), L("</dt><dd>"),
                  (1990 + k % 30).cast("string"), L("</dd><dt>"), F.when(es, L("Sector")).otherwise(L("Industry")),
                  L("</dt><dd>Wholesale</dd></dl>"))
    html = F.concat(
        L("<html><head><title>"), name, L("</title></head><body><main>"),
        F.when(k % 2 == 0, F.concat(
            L('<ul><li class="reusable-search__result-container"><a href="https://www.linkedin.com/company/supplier-'),
            k.cast("string"), L('/about/?trk=x"><span aria-hidden="true">'), name,
            L('</span><span class="visually-hidden">View</span></a><div class="entity-result__primary-subtitle">'
              'Wholesale · '), (k % 500 + 11).cast("string"),
            L(' employees</div><div class="entity-result__secondary-subtitle">'), nat, L("</div></li></ul>")))
        .otherwise(F.concat(
            L('<div class="results"><p><a href="https://www.linkedin.com/company/supplier-'), k.cast("string"),
            L('/life/">'), name, L("</a> <span>Wholesale</span> <span>Follow</span> <span>"), nat,
            L("</span></p></div>"))),
        L("<address>"), k.cast("string"), L(" Market Street, "), nat, L("</address>"),
        L('<p class="hours">Mon-Fri 09:00 - 17:00</p>'), dl,
        L('<div class="stat"><strong>'), (k * 37 % 10000).cast("string"), L("</strong><span>followers</span></div>"),
        L('<div class="office">Office '), nat, L(" branch "), k.cast("string"), L("</div>"),
        L("</main></body></html>"))
    return s.select(k.alias("page_id"), F.concat(L("https://suppliers.example.com/s/"), k.cast("string")).alias("url"),
                    html.alias("html"))


def team_pages(customer: DataFrame) -> DataFrame:
    """Member cards, ``BUCKET`` customers per page; every 5th customer's card
    appears twice (repeated name), every 7th has an empty name."""
    k = F.col("c_custkey")
    nm = F.when(k % 7 == 3, L("")).otherwise(esc(F.col("c_name")))
    card = F.concat(L('<div class="team-member"><h3>'), nm, L('</h3><span class="role">'),
                    esc(F.col("c_mktsegment")), L("</span><p>Balance "), F.format_string("%.2f", F.col("c_acctbal")),
                    L('</p><img src="/people/'), k.cast("string"), L('.jpg"></div>'))
    cards = customer.select((k / BUCKET).cast("bigint").alias("page_id"), k.alias("k"), card.alias("card"))
    dup = cards.filter(F.col("k") % 5 == 0).withColumn("k", F.col("k") + 0.5)
    cards = cards.withColumn("k", F.col("k").cast("double")).unionByName(dup)
    g = cards.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))),
                                                              lambda s: s["card"]), "").alias("body"))
    html = F.concat(L("<html><head><title>Team</title></head><body><h1>Our team</h1>"), F.col("body"),
                    L("</body></html>"))
    return g.select("page_id", F.concat(L("https://team.example.com/t/"), F.col("page_id").cast("string")).alias("url"),
                    html.alias("html"))


def talk_pages(conversations: DataFrame) -> DataFrame:
    """One page per (conversation, user turn): an FAQ block (user question,
    assistant answer of the next turn) and a testimonial block."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = conversations.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    c = c.filter((F.col("role") == "user"))
    ans = F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise(L(""))
    html = F.concat(
        L('<html><body><div class="faq-item"><h3>'), esc(F.col("text")), L("</h3><p>"), esc(ans),
        L('</p></div><blockquote class="testimonial">'), esc(F.col("text")),
        L('<cite>User '), F.col("conv_id").cast("string"), L("</cite></blockquote></body></html>"))
    pid = F.col("conv_id") * 2147483648 + F.col("turn")
    return c.select(pid.alias("page_id"), F.concat(L("https://talk.example.com/c/"), pid.cast("string")).alias("url"),
                    html.alias("html"))


def stat_pages(orders: DataFrame) -> DataFrame:
    """One page per customer with order-count and total blocks (aggregates,
    not collected lists)."""
    g = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("total"))
    html = F.concat(
        L('<html><body><div class="stats"><div class="stat-item"><span class="number">'), F.col("n").cast("string"),
        L('</span><p class="label">Orders</p></div><div class="metric"><strong>'),
        F.format_string("%.2f", F.col("total")), L("</strong><span>Total spent</span></div></div></body></html>"))
    return spread(g).select(F.col("o_custkey").alias("page_id"),
                    F.concat(L("https://stats.example.com/c/"), F.col("o_custkey").cast("string")).alias("url"),
                    html.alias("html"))


def page_versions(pages: DataFrame) -> DataFrame:
    """Two captures of each page (``page_id % 11 == 10``: only the first).
    Version 1 differs by ``page_id % 6``: 0 same, 1 title, 2 extra heading,
    3 first link removed, 4 image added, 5 sixty extra words."""
    k = F.col("page_id")
    h = F.col("html")
    words = " ".join(f"w{i}" for i in range(60))
    v1 = (F.when(k % 6 == 1, F.regexp_replace(h, "<title>", "<title>Updated "))
          .when(k % 6 == 2, F.regexp_replace(h, "<article>", "<article><h2>Breaking news</h2>"))
          .when(k % 6 == 3, F.regexp_replace(h, r'^(.*?)<li><a href="[^"]*">[^<]*</a></li>', "$1"))
          .when(k % 6 == 4, F.regexp_replace(h, "<article>", '<article><img src="/img/new.png" alt="new">'))
          .when(k % 6 == 5, F.regexp_replace(h, "</article>", f"<p>{words}</p></article>"))
          .otherwise(h))
    base = pages.select("page_id", "url", "html")
    v0 = base.select((k * 2).alias("page_id"), "url", F.lit(0).alias("version"),
                     F.lit("2024-01-01 00:00:00").cast("timestamp").alias("snapshot_ts"), "html")
    v1df = base.filter(k % 11 != 10).select((k * 2 + 1).alias("page_id"), "url", F.lit(1).alias("version"),
                                             F.lit("2024-01-02 00:00:00").cast("timestamp").alias("snapshot_ts"),
                                             v1.alias("html"))
    return v0.unionByName(v1df)


def capture_log(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Request / response / websocket logs rendered from ``events``.

    click -> xhr GET, view -> document GET, purchase -> POST JSON,
    signup -> POST GraphQL, error -> POST invalid JSON.  Every request carries
    user-agent and cookie headers; every 20th a dummy authorization header.
    """
    e = events
    k, u, t = F.col("event_id"), F.col("user_id").cast("string"), F.col("event_type")
    url = (F.when(t == "click", F.concat(L("https://api.example.com/v1/items/"), u))
           .when(t == "view", F.concat(L("https://www.example.com/page/"), u))
           .when(t == "purchase", L("https://shop.example.com/api/cart"))
           .when(t == "signup", L("https://www.example.com/graphql"))
           .otherwise(L("https://www.example.com/log")))
    method = F.when(t.isin("click", "view"), L("GET")).otherwise(L("POST"))
    rtype = (F.when(t == "click", L("xhr")).when(t == "view", L("document")).when(t == "purchase", L("fetch"))
             .when(t == "signup", L("fetch")).otherwise(L("other")))
    body = (F.when(t == "purchase", F.concat(L('{"user": '), u, L(', "value": '), F.format_string("%.2f", F.col("value")),
                                             L("}")))
            .when(t == "signup", F.concat(L('{"operationName": "Signup", "query": "mutation Signup { create(id: '), u,
                                          L(') { id } }", "variables": {"id": '), u, L("}}")))
            .when(t == "error", F.concat(L("{bad json "), k.cast("string"))))
    headers = F.map_concat(
        F.create_map(L("user-agent"), L("Mozilla/5.0"), L("cookie"), F.concat(L("sid="), u), L("accept"), L("*/*")),
        F.when(k % 20 == 0, F.create_map(L("authorization"), F.concat(L("Bearer dummy-"), k.cast("string"))))
        .otherwise(F.create_map().cast("map<string,string>")))
    ts = F.col("ts").cast("timestamp")
    req = e.select(k.alias("event_id"), ts.alias("ts"), L("https://www.example.com/app").alias("page_url"),
                   method.alias("method"), url.alias("url"), rtype.alias("resource_type"), headers.alias("headers"),
                   body.alias("post_data"))
    status = F.when(k % 10 == 0, F.lit(404)).when(k % 10 == 1, F.lit(500)).otherwise(F.lit(200))
    ctype = (F.when(t == "view", L("text/html")).when(t == "signup", L("application/json; charset=utf-8"))
             .otherwise(L("application/json")))
    rbody = (F.when(t == "view", L("<html></html>")).when(t == "error", L("not json"))
             .otherwise(F.concat(L('{"ok": true, "id": '), k.cast("string"), L(', "props": '), F.col("props"), L("}"))))
    answered = F.expr("cast(ts as timestamp) + make_dt_interval(0, 0, 0, event_id % 50)")
    resp = e.select(k.alias("event_id"), url.alias("url"), status.alias("status"), ctype.alias("content_type"),
                    rbody.alias("body"), answered.alias("ts"))
    ws = e.filter((t == "click") & (k % 3 == 0)).select(
        L("wss://stream.example.com/feed").alias("url"), ts.alias("ts"),
        F.concat(L("tick "), F.col("props")).alias("data"))
    return req, resp, ws


# --- fixed values: headlines for seniority scoring fixtures ---------------------
HEADLINES = ["Director of Operations", "Vice President, Sales", "Project Coordinator", "Co-Founder & CEO",
             "Senior Engineer", "Analyst", "Head of Marketing", "CTO", "Team Lead", "Principal Scientist",
             "Chief Executive Officer", "President"]


def headline(k: Column) -> Column:
    return F.element_at(F.array(*[L(h) for h in HEADLINES]), (k % len(HEADLINES) + 1).cast("int"))


def org_payloads(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Nested company payload per supplier (JSON text)."""
    s = spread(supplier).join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    k = F.col("s_suppkey")
    emps = F.transform(F.sequence(F.lit(0), (k % 13).cast("int")), lambda i: F.struct(
        F.concat(L("Emp"), k.cast("string"), L("_"), i.cast("string")).alias("first_name"),
        L("Lastname").alias("last_name"), F.concat(L("Role "), i.cast("string")).alias("title"),
        F.concat(L("https://people.example.com/in/e"), k.cast("string"), L("-"), i.cast("string")).alias("profile_url")))
    rounds = F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), lambda i: F.struct(
        F.element_at(F.array(L("Seed"), L("Series A"), L("Series B")), i).alias("funding_type"),
        (k * 1000 * i).alias("money_raised"), F.struct((2010 + k % 10 + i).cast("int").alias("year")).alias("announced_date"),
        F.array(F.struct(F.concat(L("Fund "), i.cast("string")).alias("name"))).alias("lead_investors")))
    hq = F.to_json(F.struct(F.concat(L("City"), (k % 50).cast("string")).alias("city"),
                            F.coalesce("n_name", L("")).alias("country")))
    body = F.struct(
        F.col("s_name").alias("name"), F.concat(L("https://s"), k.cast("string"), L(".example.com")).alias("website"),
        F.concat(L("Supplier in "), F.coalesce("n_name", L(""))).alias("description"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(L("Wholesale"), L("Logistics")))
        .alias("industries"),
        L("Trade").alias("industry"), F.array(L("parts"), L("supply")).alias("specialities"),
        (k % 500 + 11).alias("company_size_on_linkedin"), (1990 + k % 30).alias("founded_year"),
        (k * 37 % 10000).alias("follower_count"), emps.alias("employees"),
        F.when(k % 2 == 0, L("Privately Held")).alias("type"), k.cast("string").alias("linkedin_id"),
        F.concat(L("Tagline "), k.cast("string")).alias("tagline"),
        F.when(k % 4 == 0, F.array().cast("array<struct<funding_type:string,money_raised:bigint,"
                                          "announced_date:struct<year:int>,lead_investors:array<struct<name:string>>>>"))
        .otherwise(rounds).alias("funding_data"),
        (k * 1000 * (k % 3 + 1)).alias("total_funding_amount"))
    js = F.concat(F.regexp_replace(F.to_json(body), r"\}$", ""), L(', "hq": '),
                  F.when(k % 5 == 0, L('"Remote"')).otherwise(hq), L("}"))
    return s.select(k.alias("s_suppkey"), F.concat(L("https://www.linkedin.com/company/s"), k.cast("string"))
                    .alias("profile_url"), js.alias("payload"))


def person_payloads(customer: DataFrame) -> DataFrame:
    """Nested person payload per customer (JSON text)."""
    k = F.col("c_custkey")
    exps = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.struct(
        F.concat(L("Title"), i.cast("string")).alias("title"),
        F.concat(L("Co"), (k % 17).cast("string")).alias("company"), L("").alias("location"),
        F.repeat(L("desc "), i * 40).alias("description"),
        F.struct((2000 + i).cast("int").alias("year"), (i % 12 + 1).cast("int").alias("month")).alias("starts_at"),
        F.when(i == 0, F.lit(None).cast("struct<year:int,month:int>"))
        .otherwise(F.struct((2001 + i).cast("int").alias("year"), F.lit(None).cast("int").alias("month")))
        .alias("ends_at")))
    edus = F.transform(F.sequence(F.lit(1), (k % 3).cast("int")), lambda i: F.struct(
        F.concat(L("School"), i.cast("string")).alias("school"), L("BSc").alias("degree_name"),
        L("Physics").alias("field_of_study"), F.struct((1990 + i).cast("int").alias("year")).alias("ends_at")))
    body = F.struct(
        F.concat(L("First"), k.cast("string")).alias("first_name"),
        F.when(k % 9 == 0, L("")).otherwise(F.concat(L("Last"), k.cast("string"))).alias("last_name"),
        headline(k).alias("headline"), L("").alias("summary"),
        F.when(k % 4 == 0, L("")).otherwise(F.concat(L("City"), (k % 50).cast("string"))).alias("city"),
        L("Testland").alias("country_full_name"),
        exps.alias("experiences"), F.when(k % 3 == 0, F.array().cast(
            "array<struct<school:string,degree_name:string,field_of_study:string,ends_at:struct<year:int>>>"))
        .otherwise(edus).alias("education"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.concat(L("c"), k.cast("string"), L("@example.com")))).alias("personal_emails"))
    skills = F.when(k % 2 == 0, L(', "skills": [{"name": "sql"}, "python"]')).otherwise(L(', "skills": []'))
    js = F.concat(F.regexp_replace(F.to_json(body), r"\}$", ""), skills, L("}"))
    return spread(customer).select(k.alias("c_custkey"), F.concat(L("https://people.example.com/in/c"), k.cast("string"))
                           .alias("profile_url"), js.alias("payload"))


SITE_BUCKET = 10


def site_pages(supplier: DataFrame) -> DataFrame:
    """Small sites for crawl tests: one site per (nation, s_suppkey // 10).

    root ``http://n{nation}-b{bucket}.example.com/`` links every supplier page
    of the bucket (relative, root-relative and fragment forms), ``mailto:``,
    ``#``, a missing page and a duplicate link; each supplier page links home
    (``../``), itself, and ``../s/{key+1}`` (class ``next``), which is missing
    when key+1 belongs to another site.  At most ``SITE_BUCKET`` suppliers per
    site, so no page grows with the table.
    """
    s = supplier.select("s_suppkey", "s_nationkey", "s_name",
                        (F.col("s_suppkey") / SITE_BUCKET).cast("bigint").alias("b"))
    host = F.concat(L("n"), F.col("s_nationkey").cast("string"), L("-b"), F.col("b").cast("string"),
                    L(".example.com"))
    k = F.col("s_suppkey")
    href = (F.when(k % 3 == 0, F.concat(L("s/"), k.cast("string")))
            .when(k % 3 == 1, F.concat(L("/s/"), k.cast("string"), L("#top")))
            .otherwise(F.concat(L("/s/"), k.cast("string"))))
    s = s.withColumn("host", host).withColumn("href", href)
    sup_html = F.concat(
        L("<html><head><title>"), esc(F.col("s_name")), L("</title></head><body><main><h1>"), esc(F.col("s_name")),
        L('</h1><a href="../">home</a> <a href="'), k.cast("string"), L('">self</a> <a class="next" href="../s/'),
        (k + 1).cast("string"), L('">next</a></main></body></html>'))
    sup = s.select((k * 10 + 1).alias("page_id"), F.concat(L("http://"), F.col("host"), L("/s/"), k.cast("string"))
                   .alias("url"), sup_html.alias("html"))
    links = s.groupBy("s_nationkey", "b", "host").agg(
        F.array_sort(F.collect_list(F.struct("s_suppkey", "href"))).alias("l"))
    items = F.array_join(F.transform("l", lambda x: F.concat(
        L('<li><a href="'), x["href"], L('">'), x["s_suppkey"].cast("string"), L("</a></li>"))), "")
    first = F.concat(L('<a class="next" href="'), F.col("l")[0]["href"], L('">first</a>'))
    root_html = F.concat(
        L("<html><head><title>Site "), F.col("host"), L("</title></head><body><nav><ul>"), items,
        L('</ul></nav><p><a href="mailto:info@'), F.col("host"), L('">mail</a> <a href="#">top</a> '
                                                                   '<a href="/s/missing">old</a> '), first,
        L("</p></body></html>"))
    root = links.select(((F.col("b") * 1000 + F.col("s_nationkey")) * 10).alias("page_id"),
                        F.concat(L("http://"), F.col("host"), L("/")).alias("url"), root_html.alias("html"))
    return root.unionByName(sup)


def org_profile_pages(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """One organisation page per supplier; the element that carries a value changes
    with ``s_suppkey``, so every selector of a chain is met."""
    k = F.col("s_suppkey")
    s = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.when(k % 3 == 0, F.concat(L('<div class="org-top-card-summary__title"> '), esc(F.col("s_name")), L("</div>"))) \
        .otherwise(F.concat(L("<h1> "), esc(F.col("s_name")), L("</h1>")))
    about = F.concat(L("Makes "), (k % 7).cast("string"), L(" things &amp; more"))
    desc = (F.when(k % 4 == 0, F.concat(L('<p class="org-about-us-organization-description__text">'), about, L("</p>")))
            .when(k % 4 == 1, F.concat(L('<p data-test-id="about-us__description">'), about, L("</p>")))
            .when(k % 4 == 2, F.concat(L('<section class="about-us"><h2>About</h2><p>'), about, L("</p></section>"))).otherwise(L("")))
    site = F.when(k % 2 == 0, F.concat(L('<a data-control-name="visit_company_website" href="https://s'), k.cast("string"), L('.example.com/">site</a>'))) \
        .otherwise(L('<a href="https://elsewhere.example.com/">x</a>'))
    spec = F.when(k % 5 != 0, F.concat(L('<p class="org-about-us-organization-description__text--specialties">tools, , parts '),
                                       (k % 5).cast("string"), L(" ,trade</p>"))).otherwise(L(""))
    facts = F.concat(L("<dl><dt>Sede</dt><dd>"), esc(F.col("n_name")), L("</dd><dt>Founded</dt><dd>"), (1950 + k % 60).cast("string"),
                     L("</dd><dt>Industry</dt><dd>old</dd><dt>Industry</dt><dd>Trade</dd></dl>"))
    tail = F.concat(L("<p>"), F.format_number(k * 1234, 0), L(" followers</p><p>"), F.when(k % 2 == 0, L("51-200 employees")).otherwise(L("1,000+ employees")), L("</p>"))
    return s.select(k.alias("page_id"), F.concat(L("https://www.linkedin.com/company/s"), k.cast("string")).alias("url"),
                    F.concat(L("<html><body><main>"), name, desc, site, spec, facts, tail, L("</main></body></html>")).alias("html"))


def person_profile_pages(customer: DataFrame) -> DataFrame:
    """One person page per customer: chains as in ``org_profile_pages``, and up to
    twelve experience items, some without a title."""
    k = F.col("c_custkey")
    name = F.concat(L('<h1><span class="x">noise</span><span aria-hidden="true"> '), esc(F.col("c_name")), L("</span></h1>"))
    head = F.when(k % 2 == 0, F.concat(L('<div class="pv-text-details__left-panel"><div class="text-body-medium">'), esc(F.col("c_mktsegment")), L("</div></div>"))) \
        .otherwise(F.concat(L('<p class="top-card-layout__headline">'), esc(F.lower("c_mktsegment")), L("</p>")))
    place = F.when(k % 3 == 0, F.concat(L('<span class="top-card__subline-item">Nation '), F.col("c_nationkey").cast("string"), L("</span>"))).otherwise(L(""))
    about = F.when(k % 4 == 0, F.concat(L('<section><h2 id="about">About</h2><i>i</i><div><span class="visually-hidden">About '), k.cast("string"), L("</span></div></section>"))) \
        .otherwise(F.concat(L('<p class="summary">Sum '), k.cast("string"), L("</p>")))
    conn = F.concat(L("<p>"), F.format_number(k * 7, 0), L(" connections</p>"))
    items = F.array_join(F.transform(F.sequence(F.lit(1), (k % 12 + 1).cast("int")), lambda i: F.concat(
        L("<li>"), F.when(i % 4 == 3, L("")).otherwise(F.concat(L('<span aria-hidden="true">Title '), i.cast("string"), L('</span><span>twice</span><span aria-hidden="true">Co '), (k % 17).cast("string"),
                                                                L('</span><span aria-hidden="true">20'), (10 + i).cast("string"), L("</span>"))), L("</li>"))), "")
    exp = F.concat(L('<section><h2 id="experience">Experience</h2><div><ul>'), items, L("</ul></div></section>"))
    return customer.select(k.alias("page_id"), F.concat(L("https://www.linkedin.com/in/c"), k.cast("string")).alias("url"),
                           F.concat(L("<html><body><main>"), name, head, place, about, conn, exp, L("</main></body></html>")).alias("html"))


PEOPLE_BUCKET = 8


def person_result_pages(customer: DataFrame) -> DataFrame:
    """Search-result pages of up to ``PEOPLE_BUCKET`` people: cards on even pages,
    plain links in list items on odd ones."""
    k = F.col("c_custkey")
    c = customer.withColumn("page_id", (k / PEOPLE_BUCKET).cast("bigint"))
    href = F.concat(L("https://www.linkedin.com/in/c"), k.cast("string"))
    card = F.concat(L('<li class="reusable-search__result-container"><a href="'), href, L('/?mini=1"><span aria-hidden="true">'), esc(F.col("c_name")),
                    L('</span><span>View profile</span></a><div class="entity-result__primary-subtitle">'), esc(F.col("c_mktsegment")),
                    L('</div><div class="entity-result__secondary-subtitle">Nation '), F.col("c_nationkey").cast("string"), L("</div></li>"))
    link = F.concat(L('<li><a href="'), href, L('/">'), esc(F.col("c_name")), L("</a><div><span>"), esc(F.col("c_mktsegment")), L("</span></div><p>Nation "),
                    F.col("c_nationkey").cast("string"), L('</p><button>Follow</button><a href="'), href, L('/messaging">m</a></li>'))
    item = F.when(F.col("page_id") % 2 == 0, card).otherwise(link)
    g = c.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("i")))).alias("l"))   # at most PEOPLE_BUCKET
    html = F.concat(L('<html><body><nav><a href="https://www.linkedin.com/in/me">Me</a></nav><main><ul>'), F.array_join(F.transform("l", lambda x: x["i"]), ""),
                    L("</ul></main></body></html>"))
    return g.select("page_id", F.concat(L("https://www.linkedin.com/search?page="), F.col("page_id").cast("string")).alias("url"), html.alias("html"))
