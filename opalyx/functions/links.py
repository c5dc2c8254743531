"""Links of pages: how well an image or a PDF stands for a notice, and which of a notice's links are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalyx.functions import rules, text

# Scores by where an image was found, words of good and of unwanted images, hosts with habits of their own.
IMAGE_BASE = {"jsonld": 84, "link": 76, "meta": 92, "img": 58, "source": 70, "style": 62}
IMAGE_WORDS = ["article", "content", "cover", "detail", "featured", "figure", "gallery", "header-image", "hero", "image", "lead", "main", "media", "photo", "picture", "preview", "project", "render", "stage", "teaser", "visual"]
IMAGE_REFUSED = ["apple-touch-icon", "avatar", "breadcrumb", "busy_indicator", "copyright", "crown", "default-avatar", "default-user", "favicon", "globe", "header-logo", "icon", "icon-sprite", "logo", "mstile", "ogl", "placeholder", "profile", "seal", "sidebar-logo", "sig-blk", "software-logo", "spinner", "sprite", "user", "user_no_sync", "wappen", "keyvis", "link_preview"]
IMAGE_REFUSED_PATHS = r"/netserver/_images/img/|/img/browser/|/img/platforms/[^?#]*32x32"
IMAGE_LEAST = 58
PORTAL_HOST, CITY_HOST, BUYER_HOST = "konkurado.ch", "stadt-zuerich.ch", "hamburg.de"
PDF_REFUSED = r"(?iu)\b(?:terms?|conditions?|privacy|cookie|gdpr|nutzungsbedingungen|datenschutz|impressum|legal|accessibility|hilfe|help)\b"
PDF_STRONG = r"(?iu)\b(?:lageplan|site\s*plan|situationsplan|planimetr(?:ia|y)|amtlicher\s+lageplan|projektgrenzen|masterplan)\b"
PDF_GOOD = r"(?iu)\b(?:lageplan|site\s*plan|situation|situationsplan|planimetr(?:ia|y)|plano|plan|projektgrenzen|proyecto|project|brief|beschreibung|leistungsbeschreibung|memoria|sudgel[aä]nde|s[úu]dgel[aä]nde|lokhalle|campus|masterplan)\b"


def _plus(condition: Column, points: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(points)).otherwise(F.lit(0))


def _at_host(page: Column, host: str) -> Column:
    own = text.host(page)
    return (own == host) | own.endswith(f".{host}")


def image_score(url: Column, descriptor: Column, source: Column, width: Column, height: Column, page: Column) -> Column:
    """Additive score of an image candidate, null where it is refused; those under IMAGE_LEAST aren't used."""
    low, words = F.lower(url), F.lower(F.concat_ws(" ", url, descriptor))
    hits = sum((_plus(words.contains(w), 8) for w in IMAGE_WORDS), F.lit(0))
    base = F.create_map(*[F.lit(x) for kv in IMAGE_BASE.items() for x in kv])[source]
    score = base + F.least(F.lit(24), hits)
    score = score + _plus(low.endswith(".svg"), -20) + _plus(low.endswith(".gif"), -28) + _plus(words.rlike(r"\bthumb|thumbnail|tiny|small|mini|xs|sm\b"), -18)
    score = score + _plus(words.rlike("landscape|ratio16x9|wide|hero|cover|teaser"), 8) + _plus(low.rlike("/resource/image/|/media/|/uploads?/"), 4)
    portal, city, buyer = (_at_host(page, h) for h in (PORTAL_HOST, CITY_HOST, BUYER_HOST))
    score = score + _plus(portal & low.rlike(r"/thumbs/\d+x\d+/competitions/"), 56) + _plus(portal & low.contains("/storage/competitions/"), -18) + _plus(portal & low.contains("/logo/"), -32)
    score = score + _plus(city & low.rlike(r"(?:/_jcr_content/pageimage\b|/bilder/.+/teaser/)"), 18) + _plus(city & low.contains("/corporate-design/"), -36) + _plus(buyer & low.contains("/resource/image/"), -48)
    score = score + F.when(width >= 1200, 12).when(width >= 800, 10).when(width >= 400, 6).when(width <= 160, -30).when(width <= 240, -14).otherwise(0)
    score = score + F.when(height >= 400, 6).when(height <= 160, -18).otherwise(0)
    return F.when(~(low.rlike(IMAGE_REFUSED_PATHS) | rules.any_of(words, IMAGE_REFUSED)), score)


def best_image(candidates: DataFrame, key: str) -> DataFrame:
    """(key, url, score) of the best candidate (key, place, url, score) of each key; the first found of equals."""
    fit = candidates.filter(F.col("score") >= IMAGE_LEAST)
    return fit.groupBy(key).agg(F.max_by(F.struct("url", "score"), F.struct("score", -F.col("place"))).alias("b")).select(key, "b.*")


def pdf_score(url: Column, context: Column) -> Column:
    """Points of a PDF link by its words and those around it; null where it is refused or no PDF."""
    is_pdf = F.lower(url).rlike(r"\.pdf(?:[?#].*)?$") | context.rlike(r"(?i)\.pdf\b")
    near, own = F.regexp_replace(context, "[_+-]", " "), F.regexp_replace(url, "[_+-]", " ")
    score = _plus(near.rlike(PDF_STRONG), 4) + _plus(own.rlike(PDF_STRONG), 2) + _plus(near.rlike(PDF_GOOD), 2) + _plus(own.rlike(PDF_GOOD), 1)
    return F.when(is_pdf & ~F.concat_ws(" ", url, context).rlike(PDF_REFUSED), score)


def best_pdfs(candidates: DataFrame, key: str, most: int = 3) -> DataFrame:
    """The best PDF links (key, url, score) of each key; of equal scores the first by its address."""
    once = candidates.filter(F.col("score").isNotNull()).groupBy(key, "url").agg(F.max("score").alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "url")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def shown_links(official: Column, documents: Column, brief: Column, source: Column) -> Column:
    """Struct of the links a notice shows: each address once, and no address that only machines read."""
    portal = F.when(~documents.eqNullSafe(official) & ~documents.eqNullSafe(brief), documents)
    page = F.when(~text.machine_url(official), official)
    trace = F.when(~source.eqNullSafe(page) & ~source.eqNullSafe(portal) & ~source.eqNullSafe(brief), source)
    return F.struct(portal.alias("documents_portal"), page.alias("official_page"), trace.alias("source_trace"))


def category_label(project: Column, building: Column, fallback: Column) -> Column:
    return F.coalesce(F.when(project.isNotNull() & building.isNotNull() & (project != building), F.concat_ws(" · ", project, building)), project, building, fallback)


def location_label(jurisdiction: Column, place: Column) -> Column:
    both = F.when(place.isNotNull() & (text.location_key(place) != text.location_key(jurisdiction)), F.concat_ws(" · ", jurisdiction, place))
    return F.coalesce(both, text.or_null(jurisdiction), place, F.lit("Unknown"))
