"""Crawled content and rules: robots files, challenge pages, platforms, guides, map features, addresses, JSON for search engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U

#: Marks of pages that ask whether the visitor is a robot.
CHALLENGES = [
    r"(?i)<title>\s*just a moment", r"(?i)/cdn-cgi/challenge-platform/", r"(?i)_cf_chl_opt|cf-chl-|cf_chl_", r"(?i)<title>\s*attention required!? \| cloudflare", r"(?i)_incapsula_resource|incapsula incident",
    r"(?i)sucuri website firewall", r"(?i)captcha-delivery\.com", r"(?i)px-captcha|perimeterx", r"(?i)awswaf|gokuprops",
]
#: Links that tell of membership, of the club, and of rates, the best first; names and operators of map features.
ABOUT_LINKS = [
    r"(?i)\bmembership\b|\bmember(s|ship)?[-_ ]?(info|information|benefits)?\b|\bjoin\b",
    r"(?i)\babout\b|\bour[-_ ]?(club|course|history)\b|\bhistory\b|\bthe[-_ ]club\b",
    r"(?i)\brates?\b|\bgreen[-_ ]?fees?\b|\btee[-_ ]?times?\b|\bpublic\b",
]
NO_COURSE = r"(?i)mini ?golf|miniature|\bputt(?:-putt|ing)?\b|\btop ?golf\b|driving range"
MUNICIPAL = r"(?i)\bcity of\b|\bcounty\b|\bparks\b|\brecreation\b|\bstate park\b"
#: What no city's name has, and what it is made of.
NO_CITY = [r"\d", r"(?i)\b(suite|ste|floor|fl|unit|apt|po box|box)\b", r"^[A-Z]{1,2}$"]
CITY_NAME, CITY_LENGTHS = r"^[A-Za-z][A-Za-z .'\-]*$", (2, 40)
#: Lines of guides that are not allowed.
HEADING, SETEXT, RAW_HTML, IMAGES = r"^\s{0,3}(#{1,6})(\s|$)", r"^\s{0,3}=+\s*$", r"(?i)</?[a-z][a-z0-9-]*(\s[^>]*)?/?>", [r"!\[[^\]]*\]\([^)]*\)", r"!\[[^\]]*\]\[[^\]]*\]"]
#: Words that the site's texts never use.
BANNED = ["exclusive", "elite", "prestigious", "bucket list"]
#: IPv4 networks that are not public.
PRIVATE_V4 = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
LONGEST_DELAY = 30


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """The rules that hold for an agent: ``host``, ``allow``, ``pattern``, ``crawl_delay``. files: host, text.

    Lines of user agents that follow each other share the rules after them; groups that name the agent count, else those for all.
    """
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    lines = files.select("host", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "line")).withColumn("line", line).where(F.col("line").rlike(r"^[A-Za-z-]+\s*:"))
    lines = lines.select("host", "n", F.lower(F.regexp_extract("line", r"^([A-Za-z-]+)\s*:", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[A-Za-z-]+\s*:\s*(.*)$", 1)).alias("value")).where("key <> 'sitemap'")
    by_line = Window.partitionBy("host").orderBy("n")
    begins = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(by_line), F.lit("")) != "user-agent")
    lines = lines.withColumn("group", F.sum(begins.cast("int")).over(by_line)).where(F.col("group") > 0)
    token = F.lower(F.regexp_extract("value", r"^([A-Za-z_-]+)", 1))
    agents = lines.where("key = 'user-agent'").select("host", "group", F.when(F.col("value") == "*", "*").otherwise(token).alias("agent")).where(F.col("agent").isin("*", agent.lower())).distinct()
    own = agents.groupBy("host").agg(F.max((F.col("agent") != "*").cast("int")).alias("named"))
    chosen = agents.join(own, "host").where((F.col("named") == 0) | (F.col("agent") != "*")).select("host", "group").distinct()
    mine = lines.join(chosen, ["host", "group"])
    delay = F.max(F.when(F.col("key") == "crawl-delay", F.col("value").try_cast("double"))).over(Window.partitionBy("host"))
    mine = mine.withColumn("crawl_delay", F.least(F.coalesce(delay, F.lit(0.0)), F.lit(float(LONGEST_DELAY))))
    return mine.where("key in ('allow', 'disallow') and value <> ''").select("host", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"), "crawl_delay")


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id`` and ``allowed`` for pages (page_id, host, path): the longest pattern that fits decides, an allowing one among equals; without one all is allowed. Only rules of the page's host meet it."""
    escaped = F.regexp_replace("pattern", r"([.+?^${}()|\[\]\\])", r"\\$1")
    as_regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\\\$$", r"\$"))
    fitting = pages.join(rules.withColumn("regex", as_regex), "host").where(F.expr("path rlike regex"))
    best = fitting.groupBy("page_id").agg(F.max_by("allow", F.struct(F.length("pattern"), F.col("allow"))).alias("allow"))
    return pages.select("page_id").join(best, "page_id", "left").select("page_id", F.coalesce("allow", F.lit(True)).alias("allowed"))


def is_challenge(body: Column) -> Column:
    head = F.substring(body, 1, 64 * 1024)
    found = F.lit(False)
    for pattern in CHALLENGES:
        found |= head.rlike(pattern)
    return head.rlike(r"(?i)<(!doctype\s+html|html|head|body|script|title)[\s>]") & found


def platform_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id``, ``platform``, ``allowed``, ``listing``, ``directory`` of pages (page_id, url) on a listed platform. rules: ord, platform, allowed, domain, listing_pattern, directory, event_pattern; the first rule of a domain counts. A domain "name.*" fits any ending."""
    # a column for each step, which is then worked out once
    hosts = pages.select("page_id", "url", U.host(F.col("url")).alias("_host"))
    domains = hosts.select("page_id", "url", U.domain(F.col("_host")).alias("_domain"))
    asked = domains.select("page_id", "url", F.explode(F.array(F.col("_domain"), F.concat(F.substring_index("_domain", ".", 1), F.lit(".*")))).alias("domain"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))
    first = asked.join(rules, "domain").withColumn("rank", rank).where("rank = 1")
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    listing = F.coalesce(F.expr("listing_path rlike listing_pattern"), F.lit(False)) | (F.col("directory") & F.coalesce(~F.expr("lower(url) rlike lower(event_pattern)"), F.lit(False)))
    return first.withColumn("listing_path", path).withColumn("listing", listing).select("page_id", "platform", "allowed", "listing", "directory")


def about_links(pages: DataFrame) -> DataFrame:
    """Each page's best link about itself: ``page_id``, ``href``. pages: page_id, url, html."""
    links = pages.select("page_id", "url", F.posexplode(H.links(F.col("html"))).alias("ord", "link")).select("page_id", "url", "ord", "link.href", "link.text")
    home = F.regexp_replace(U.host(F.col("url")), r"^www\.", "")
    target = F.regexp_replace(U.host(F.col("href")), r"^www\.", "")
    inside = F.col("href").startswith("/") | F.coalesce(target == home, F.lit(False))
    hay = F.concat_ws(" ", "text", F.regexp_replace("href", "[/_-]+", " "))
    rank = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate(ABOUT_LINKS))):
        rank = F.when(hay.rlike(pattern), i).otherwise(rank)
    ranked = links.where(inside & ~F.col("href").rlike(r"(?i)\.(pdf|jpe?g|png|gif|zip|docx?)$")).withColumn("rank", rank).where("rank is not null")
    return ranked.groupBy("page_id").agg(F.min_by("href", F.struct("rank", "ord")).alias("href"))


def event_links(links: DataFrame) -> DataFrame:
    """First-seen links over all pages, in the pages' order: page_id, ord, href; one row for each address."""
    return links.groupBy("href").agg(F.min(F.struct("page_id", "ord")).alias("at")).select("href", "at.page_id", "at.ord")


def is_excluded_feature(tags: Column) -> Column:
    name = F.trim(F.try_element_at(tags, F.lit("name")))
    return F.coalesce(name, F.lit("")).eqNullSafe("") | F.coalesce(F.try_element_at(tags, F.lit("golf")) == "driving_range", F.lit(False)) | F.coalesce(name.rlike(NO_COURSE), F.lit(False))


def feature_type(tags: Column) -> Column:
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    return F.when(tag("access") == "private", "private").when((tag("operator:type") == "government") | tag("operator").rlike(MUNICIPAL), "municipal").when(tag("access").isin("yes", "public"), "public")


def is_city_name(value: Column) -> Column:
    """A few letters with spaces, dots, hyphens and apostrophes; no numbers, no part of an address, no abbreviation of a state."""
    name = F.trim(value)
    unlike = [name.rlike(p) for p in NO_CITY]
    return name.rlike(CITY_NAME) & F.length(name).between(*CITY_LENGTHS) & ~(unlike[0] | unlike[1] | unlike[2])


def v4_number(address: Column) -> Column:
    parts = F.split(address, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + F.coalesce(p.try_cast("long"), F.lit(0)))
    valid = address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    return F.when(valid, number)


def is_blocked_address(address: Column) -> Column:
    """Anything but a public IPv4 address; of IPv6, what is outside the global range or wraps an IPv4 address."""
    n = v4_number(address)
    private = F.lit(False)
    for network in PRIVATE_V4:
        base, bits = network.split("/")
        low = sum(int(p) << 8 * (3 - i) for i, p in enumerate(base.split(".")))
        private |= n.between(low, low + (1 << 32 - int(bits)) - 1)
    bare = F.lower(F.regexp_replace(address, r"^\[|\]$", ""))
    groups = F.split(bare, ":")
    full = F.filter(groups, lambda g: g != "")
    # eight groups, or fewer around one gap
    shape = F.when(bare.contains("::"), (F.size(F.split(bare, "::")) == 2) & ~bare.contains(":::") & (F.size(full) <= 7) & ~bare.rlike("(^:[^:]|[^:]:$)")).otherwise((F.size(groups) == 8) & (F.size(full) == 8))
    v6 = bare.contains(":") & shape & F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    open_v6 = v6 & bare.rlike(r"^[23][0-9a-f]{3}:") & ~bare.rlike(r"^2002:|^2001:0?db8:|^2001:(0{0,3}[0-9a-f]?|0{0,2}[0-9a-f]{2}|0?1[0-9a-f]{2}):")
    return ~((n.isNotNull() & ~private) | (n.isNull() & open_v6))


def merged_aliases(name: Column, known: Column, more: Column) -> Column:
    """Known aliases and those of ``more`` that are new, in order; case does not tell them apart, and the name itself is none."""
    return F.aggregate(more, known, lambda have, a: F.when(F.exists(F.concat(have, F.array(name)), lambda k: F.lower(k) == F.lower(a)), have).otherwise(F.concat(have, F.array(a))))


def guide_problems(guides: DataFrame) -> DataFrame:
    """``guide_id``, ``line``, ``problem`` of guides (guide_id, body): headings other than ## and ###, raw HTML, images; not inside fences."""
    lines = guides.select("guide_id", F.posexplode(F.split("body", r"\r?\n")).alias("i", "text"))
    by_line = Window.partitionBy("guide_id").orderBy("i")
    fence = F.col("text").rlike(r"^\s*(```|~~~)")
    lines = lines.withColumn("fence", fence).withColumn("fences", F.sum(fence.cast("int")).over(by_line)).withColumn("before", F.coalesce(F.lag("text").over(by_line), F.lit("")))
    open_lines = lines.where("not fence and fences % 2 = 0")
    level = F.length(F.regexp_extract("text", HEADING, 1))
    text = F.col("text")
    checks = F.array_compact(
        F.array(
            F.when((level > 0) & ~level.isin(2, 3), F.concat(F.lit("heading level "), level.cast("string"), F.lit("; use ## or ###"))),
            F.when(text.rlike(SETEXT) & (F.trim("before") != ""), F.lit("setext H1 heading; use ##")),
            F.when(text.rlike(RAW_HTML) | text.rlike("<!--"), F.lit("raw HTML")),
            F.when(text.rlike(IMAGES[0]) | text.rlike(IMAGES[1]), F.lit("image")),
        )
    )
    return open_lines.select("guide_id", (F.col("i") + 1).alias("line"), F.explode(checks).alias("problem"))


def banned_words(text: Column) -> Column:
    """The BANNED words that a text uses, in their order; whole words, however they are spaced and written."""
    found = [F.when(text.rlike(r"(?i)\b" + word.replace(" ", r"\s+") + r"\b"), word) for word in BANNED]
    return F.array_compact(F.array(*found))


def guide_words(body: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"(?s)```.*?```", " "), r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[#>*_`|~-]+", " ")
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w.rlike("[A-Za-z0-9]")))


def front_matter(markdown: Column) -> Column:
    """A struct of ``data`` (map of flat "key: value" lines) and ``body``; null without a block at the top."""
    pattern = r"(?s)^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)(.*)$"
    lines = F.filter(F.split(F.regexp_extract(markdown, pattern, 1), r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2")
    data = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1), value(x))))
    return F.when(markdown.rlike(pattern), F.struct(data.alias("data"), F.regexp_extract(markdown, pattern, 2).alias("body")))


def event_json(rows: DataFrame) -> DataFrame:
    """``id`` and ``json`` for search engines; what is not known is left out. rows: id, title, start_date, end_date, status, course_name, city, state, single_price_cents."""
    offer = F.when(F.col("single_price_cents").isNotNull(), F.struct(F.lit("Offer").alias("@type"), (F.col("single_price_cents") / 100).alias("price"), F.lit("USD").alias("priceCurrency")))
    address = F.struct(F.lit("PostalAddress").alias("@type"), F.col("city").alias("addressLocality"), F.col("state").alias("addressRegion"))
    where = F.struct(F.lit("Place").alias("@type"), F.col("course_name").alias("name"), address.alias("address"))
    status = F.concat(F.lit("https://schema.org/"), F.when(F.col("status") == "cancelled", "EventCancelled").otherwise("EventScheduled"))
    event = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("title").alias("name"), F.col("start_date").alias("startDate"), F.col("end_date").alias("endDate"), status.alias("eventStatus"), where.alias("location"), offer.alias("offers"))
    text = F.to_json(event)
    for character, escape in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(character), F.lit(escape))
    return rows.where("start_date is not null").select("id", text.alias("json"))


def breadcrumb_json(names: Column, urls: Column) -> Column:
    """A BreadcrumbList of names and addresses (arrays of the same length)."""
    items = F.transform(F.arrays_zip(names.alias("name"), urls.alias("item")), lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["name"].alias("name"), x["item"].alias("item")))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement")))


def item_list_json(urls: Column) -> Column:
    items = F.transform(urls, lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x.alias("url")))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), items.alias("itemListElement")))
