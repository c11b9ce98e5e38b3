"""A use-case model from routes: which routes count, who acts, on what domain, and what the diagram says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scalars import singular

#: Paths and segments that are no business goals.
STATIC_ASSET = r"(?i)\.(css|js|mjs|map|png|jpe?g|gif|svg|ico|woff2?|ttf|eot|html?|txt|webp|avif)$"
UI_SCREEN_PREFIX = r"(?i)^(add|edit|view|new|my|mobile|reset|check|cc)-[a-z0-9-]+$"
UI_SCREEN_SUFFIX = r"(?i)^.+-(demo|demos|test|tests|info|infos|detail|details)$"
TECH_SEGMENT = r"(?i)^((.+-)?(rest|rests|api|apis)|.*(delete-check|check-delete)[a-z]*)$"
ROLE_WORDS = ("admin", "auth", "home", "index")
TECH_WORDS = ("rest", "api")
ANY_USER = ("USER", "USERS", "MEMBER", "AUTHENTICATED", "AUTH", "")
REPORTING = r"(?i)(analytic|statistic|dashboard|audit|report|metric|insight)"


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(r"^\{[^}]*\}$"))


#: Beginnings, whole paths and parts that are no business goals.
EXCLUDED_STARTS = ("/actuator", "/health", "/metrics", "/swagger-ui", "/v3/api-docs", "/api/docs", "/static", "/assets", "/webjars", "/test", "/home/", "/index/")
EXCLUDED_PATHS = ("/error", "/favicon.ico", "/", "/home", "/index")
EXCLUDED_PARTS = ("/debug", "/internal", "/__", "/test/")
AUTH_GOALS = ("register", "signup", "sign-up", "login", "signin", "sign-in")
MUTATING = ("POST", "PUT", "PATCH", "DELETE")


def excluded(path: Column) -> Column:
    """Whether a path is no business goal: blank, plumbing, an asset, a landing page, a screen, or technical parts of signing in."""
    p = F.lower(F.coalesce(path, F.lit("")))
    any_of = lambda tests: F.coalesce(*[F.when(t, F.lit(True)) for t in tests], F.lit(False))
    plumbing = any_of([F.trim(p) == "", p.isin(*EXCLUDED_PATHS), *[p.startswith(x) for x in EXCLUDED_STARTS], *[F.contains(p, F.lit(x)) for x in EXCLUDED_PARTS]])
    parts = F.filter(F.split(p, "/"), lambda s: (F.trim(s) != "") & ~s.rlike(r"^\{[^}]*\}$") & (s != "api") & ~s.rlike(r"^v\d+$"))
    last = F.try_element_at(parts, F.lit(-1))
    screen = F.exists(parts, lambda s: s.rlike(TECH_SEGMENT)) | F.coalesce(last.rlike(UI_SCREEN_PREFIX) | last.rlike(UI_SCREEN_SUFFIX), F.lit(False))
    technical = (F.contains(p, F.lit("/auth/")) | p.endswith("/auth")) & ~signs_in(p)
    return plumbing | p.rlike(STATIC_ASSET) | screen | technical


def signs_in(path: Column) -> Column:
    """Whether a path in lower case is a goal of signing in or up."""
    return F.coalesce(*[F.when(F.contains(path, F.lit(x)), F.lit(True)) for x in AUTH_GOALS], F.lit(False))


def goals(endpoints: DataFrame) -> DataFrame:
    """Endpoints (route, method, path, controller, role, is_view) that are goals of a user: not excluded, and no pages that are only read, but for signing in."""
    page = F.coalesce("is_view", F.lit(False)) & ~F.upper(F.coalesce("method", F.lit(""))).isin(*MUTATING) & ~signs_in(F.lower(F.coalesce("path", F.lit(""))))
    return endpoints.where(~page & ~excluded(F.col("path")))


def auth_kind(path: Column, controller: Column) -> Column:
    signal = F.lower(F.concat_ws(" ", path, controller))
    return F.when(signal.rlike("register|signup|sign-up"), "REGISTER").when(signal.rlike("login|signin|sign-in"), "LOGIN")


def actor(path: Column, role: Column) -> tuple[Column, Column]:
    """Actor and confidence: by the role that a route requires, else Admin below /admin, else User as a guess."""
    r = F.upper(F.coalesce(role, F.lit("")))
    bare = F.regexp_replace(r, "^ROLE_", "")
    admin, named = r.rlike("ADMIN|SUPERUSER|ROOT"), F.trim(r) != ""
    own = F.initcap(F.trim(F.regexp_replace(F.lower(bare), "[_\\-\\s]+", " ")))
    below = F.contains(F.lower(path), F.lit("/admin"))
    who = F.when(named & admin, "Admin").when(named & bare.isin(*ANY_USER), "User").when(named, own).when(below, "Admin").otherwise("User")
    sure = F.when(named & admin, 0.95).when(named & bare.isin(*ANY_USER), 0.9).when(named, 0.85).when(below, 0.9).otherwise(0.7)
    return who, sure


def domain(path: Column, controller: Column) -> tuple[Column, Column]:
    """Domain and confidence: the controller's words without roles in front and plumbing behind, else the path's first noun, else Resource."""
    split = F.split(F.trim(F.regexp_replace(F.coalesce(controller, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")), "\\s+")
    n = F.transform(split, lambda w: singular(w))
    text = F.regexp_replace(F.regexp_replace(F.array_join(n, " "), f"(?i)^((?:{'|'.join(ROLE_WORDS)})\\s+)+(?=\\S)", ""), f"(?i)(?<=\\S)(\\s+(?:{'|'.join(TECH_WORDS)}))+$", "")
    sound = (text != "") & ~F.lower(text).isin(*ROLE_WORDS, *TECH_WORDS, "delete check", "check delete")
    nouns = F.filter(segments(path), lambda s: ~F.lower(s).isin("api", "admin", "auth") & ~F.lower(s).rlike("^v\\d+$"))
    noun = singular(F.try_element_at(nouns, F.lit(1)))
    word = F.concat(F.upper(F.substring(noun, 1, 1)), F.substring(noun, 2, 1 << 20))
    return F.when(sound, text).otherwise(F.coalesce(word, F.lit("Resource"))), F.when(sound, 0.9).when(noun.isNotNull(), 0.6).otherwise(0.3)


def inferred(endpoints: DataFrame) -> DataFrame:
    """route, method, actor, actor_confidence, domain, domain_confidence, auth of the endpoints that are goals."""
    who, sure = actor(F.col("path"), F.col("role"))
    what, known = domain(F.col("path"), F.col("controller"))
    return goals(endpoints).select("route", "method", who.alias("actor"), sure.alias("actor_confidence"), what.alias("domain"), known.alias("domain_confidence"), auth_kind(F.col("path"), F.col("controller")).alias("auth"))


def use_cases(model: DataFrame, manage: float = 0.25) -> DataFrame:
    """domain, title, actors, endpoint_count, confidence: one use case a domain; Manage if writes are at least the share `manage` and it is no report."""
    write = F.col("method").isin("POST", "PUT", "PATCH", "DELETE")
    g = model.where("auth is null").groupBy("domain").agg(F.count(F.lit(1)).alias("endpoint_count"), F.count_if(write).alias("writes"), F.array_join(F.array_sort(F.collect_set("actor")), ", ").alias("actors"), F.max("domain_confidence").alias("confidence"))
    verb = F.when((F.col("writes") >= manage * F.col("endpoint_count")) & ~F.col("domain").rlike(REPORTING), "Manage").otherwise("View")
    return g.select("domain", F.concat_ws(" ", verb, F.concat(F.col("domain"), F.lit("s"))).alias("title"), "actors", "endpoint_count", "confidence")


def beautified(labels: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Labels (id, title) with the lexicon's (term, label) name where it has one; a term is matched whatever its case."""
    terms = lexicon.select(F.lower("term").alias("term"), "label")
    return labels.join(terms, F.lower("title") == F.col("term"), "left").select("id", F.coalesce("label", "title").alias("title"))


def fallback_cases(nodes: DataFrame) -> DataFrame:
    """name, tier: use cases from classes where there are no routes: of services, else controllers, else entities, else any class."""
    tier = F.when(F.endswith("name", F.lit("Service")), 0).when(F.endswith("name", F.lit("Controller")), 1).when(F.col("type") == "DBModel", 2).otherwise(3)
    t = nodes.where(F.col("type").isin("Class", "DBModel", "Record")).select(F.regexp_replace("name", "(Service|Controller|Entity|Repository)$", "").alias("name"), tier.alias("tier"))
    best = t.agg(F.min("tier").alias("best"))
    return t.crossJoin(F.broadcast(best)).where("tier = best").select("name", "tier").distinct()  # one row


def plantuml(cases: DataFrame) -> DataFrame:
    """line, text of a PlantUML diagram: actors, then use cases, then associations, each by name; a row a line."""
    a = cases.select(F.explode(F.split("actors", ", ")).alias("actor"), "title", "domain")
    alias = F.regexp_replace("domain", "[^A-Za-z0-9]", "")
    rows = [
        cases.select(F.lit("0").alias("line"), F.lit("@startuml").alias("text")).distinct(),
        a.select(F.concat(F.lit("1"), "actor").alias("line"), F.concat(F.lit("actor "), "actor").alias("text")).distinct(),
        cases.select(F.concat(F.lit("2"), "domain").alias("line"), F.concat(F.lit('usecase "'), "title", F.lit('" as '), alias).alias("text")),
        a.select(F.concat(F.lit("3"), "actor", F.lit("|"), "domain").alias("line"), F.concat("actor", F.lit(" --> "), alias).alias("text")),
        cases.select(F.lit("4").alias("line"), F.lit("@enduml").alias("text")).distinct(),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out
