"""What a notice of the term-search register is about, and whether it counts: labels, weights, vetoes, thresholds.

All of it is Column expressions over three texts: the title, the body and the register's own category.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opalyx.functions import dates, rules
from opalyx.functions.text import WS, bind

# Labels with the words they are found by.
SECTORS = {"building_construction": ["房屋建筑", "房建工程", "建筑工程"], "design_consulting": ["勘察设计", "建筑设计", "建筑装饰", "装饰装修"]}
ASSETS = {
    "interior": ["室内设计", "精装修设计", "建筑室内", "公区"],
    "healthcare": ["医院", "病房", "住院楼", "门诊楼", "应急救治中心", "医共体"],
    "education": ["学校", "教学楼", "校区", "校园", "幼儿园", "托育中心"],
    "housing": ["住宅", "小区", "居住建筑", "居住用地", "棚户区", "城中村"],
    "office_research": ["办公楼", "研发办公楼", "科研楼", "产业园"],
    "civic_culture": ["图书馆", "文化中心", "文化宫", "博物馆", "档案馆", "科技馆", "剧院", "展览馆", "会展中心", "市民服务中心"],
    "welfare": ["福利院", "养老服务中心"],
    "hospitality_commercial": ["酒店", "会所", "商业设施用地", "综合体"],
    "land_use_planning": ["托幼用地"],
    "urban_renewal": ["老旧小区改造", "老旧街区", "街区修复", "城市更新", "片区改造"],
}
SCOPES = {
    "interior_design": ["室内设计", "装修设计", "精装修设计", "建筑室内", "灯光设计"],
    "architectural_design": ["建筑设计", "建筑方案", "建筑概念方案", "建筑方案设计"],
    "scheme": ["概念设计", "方案设计"],
    "preliminary": ["初步设计"],
    "construction_docs": ["施工图设计"],
    "planning": ["修建性详细规划"],
    "design_service": ["设计服务"],
}
MODES = {"renovation": ["改造", "提升", "修缮", "修复", "更新", "加固"], "extension": ["扩建", "改扩建"], "new_build": ["新建", "建设项目", "拟建地块"]}
DOMAINS = {
    "transport": ["道路", "公路", "桥梁", "桥涵", "隧道", "地铁", "轨道", "铁路", "港口", "航道", "交通工程"],
    "underground": ["地下", "地下管网", "管网", "管廊", "综合管廊", "给排水", "污水"],
    "water": ["水利", "水务", "河道", "堤防", "排污口", "防浪消浪", "蓝藻隔离带", "水体透明度恢复", "沉水植物", "生态围网"],
    "ecology_environment": ["生态修复", "污染修复工程", "水污染防治工程", "环境整治"],
    "mining": ["矿山", "矿坑", "矿业工程"],
    "agriculture_rural": ["和美乡村", "农业农村", "农田", "乡村"],
}
DISCIPLINE = ["建筑行业（建筑工程）", "建筑行业(建筑工程)", "建筑装饰工程设计专项", "注册建筑师", "一级注册建筑师"]
STOPS = ["投标人资格要求", "申请人资格要求", "供应商资格要求", "资格要求", "资格审查", "地 址：", "地址：", "联系人：", "联系电话：", "电 话：", "电话：", "获取招标文件", "获取采购文件", "响应文件提交", "响应文件开启", "投标文件的递交", "投标文件递交", "投标保证金", "评标办法", "采购人信息", "联系方式", "招标代理机构"]
NEW_BUILD = ["新建", "拟建地块"]
REFUSED_CATEGORIES = ["水利工程", "交通工程", "公路工程", "铁路工程", "轨道交通", "港口与航道工程", "市政工程", "矿业工程", "环保工程"]
REFUSED_WORDS = ["油气", "钻探", "钻井", "地震资料解释", "井位设计", "地质工程", "油藏", "农用地土壤污染", "海洋牧场", "入河排污口", "绩效方案设计", "配套软件服务"]
DESIGN_WORDS = ["室内设计", "装修设计", "精装修设计", "概念设计", "方案设计", "初步设计", "施工图设计", "建筑设计", "设计服务", "灯光设计"]
CONTEXT_WORDS = ["建筑装饰", "建筑方案", "建筑概念方案", "建筑方案设计", "居住用地", "居住建筑", "住宅", "小区", "教学楼", "学校", "校区", "校园", "托幼", "幼儿园", "医院", "病房", "住院楼", "门诊楼", "应急救治中心", "门诊", "酒店", "办公楼", "研发办公楼", "图书馆", "文化中心", "公共建筑", "福利院", "养老服务中心", "会所", "商业设施用地", "建筑装饰工程", "建筑行业（建筑工程）", "建筑行业(建筑工程)", "注册建筑师", "一级注册建筑师"]
# Weights of words.
TITLE_WEIGHTS = {"室内设计": 8, "精装修设计": 8, "建筑设计": 7, "建筑室内": 5, "老旧小区改造": 6, "教学楼": 6, "学校": 5, "校园": 5, "医院": 5, "病房改造": 5, "病房": 4, "住院楼": 4, "门诊楼": 4, "应急救治中心": 4, "酒店": 4, "办公楼": 4, "图书馆": 4, "文化中心": 4, "会所": 4, "福利院": 4, "养老服务中心": 4, "居住用地": 6, "托幼用地": 6, "幼儿园": 5, "修建性详细规划": 3, "方案设计": 2, "初步设计": 2, "设计服务": 1}
BODY_WEIGHTS = {"建筑装饰工程设计专项": 5, "建筑行业（建筑工程）": 4, "建筑行业(建筑工程)": 4, "注册建筑师": 4, "一级注册建筑师": 4, "室内二次机电": 3, "灯光设计": 3, "施工图设计": 3, "概念设计": 2, "方案设计": 2, "初步设计": 2, "商业设施用地": 3, "居住建筑": 3, "病房改造": 3, "住院楼": 3, "门诊楼": 3, "福利院": 3, "养老服务中心": 3}
OBJECT_WEIGHTS = {"室内设计": 6, "精装修设计": 6, "建筑装饰": 4, "会所": 4, "酒店": 4, "学校": 4, "教学楼": 4, "校区": 4, "医院": 4, "病房改造": 5, "病房": 4, "门诊": 4, "住院楼": 4, "门诊楼": 4, "应急救治中心": 4, "办公楼": 4, "图书馆": 4, "文化中心": 4, "博物馆": 4, "档案馆": 4, "科技馆": 4, "剧院": 4, "展览馆": 4, "会展中心": 4, "市民服务中心": 4, "游客中心": 3, "游客服务中心": 3, "住宅": 4, "小区": 4, "居住建筑": 4, "老旧小区改造": 5, "居住用地": 4, "托幼用地": 4, "幼儿园": 4, "托育中心": 4, "公共建筑": 4, "福利院": 4, "养老服务中心": 4, "商业设施用地": 3, "综合体": 3}
CONTEXTUAL_PENALTIES = {"和美乡村": 5, "农业农村": 4, "乡村": 3, "生态旅游": 3, "矿山": 3, "排污口": 4, "生态修复": 4, "水利工程": 5, "河道整治": 5, "污染修复工程": 4, "水污染防治工程": 4, "防浪消浪": 4, "蓝藻隔离带": 4, "水体透明度恢复": 4, "沉水植物": 4, "生态围网": 3}
PENALTIES = {"和美乡村": 5, "农业农村": 4, "乡村": 3, "生态旅游": 3, "矿山": 3, "排污口": 4, "生态修复": 3, "水利工程": 4, "河道整治": 4, "污染修复工程": 3, "水污染防治工程": 3, "污水": 3, "给排水": 2, "道路": 2, "排水工程": 2, "市政": 2, "基础设施": 2, "环境整治": 2}
SITE_PENALTIES = {"生态修复": 3, "防浪消浪": 3, "蓝藻隔离带": 3, "水体透明度恢复": 3, "沉水植物": 3, "生态围网": 2, "矿坑": 3, "矿山遗址": 3, "园区道路": 3, "道路工程": 3, "停车场": 2, "绿化": 2, "公共厕所": 2, "公厕": 2, "大门": 1, "攀岩": 1, "景观": 2, "广场铺装": 2, "室外管网": 2}


# Labels of deadlines with their scores, in the order they are looked for, and words that add to them.
DEADLINE_LABELS = {
    "投标文件递交的截止时间为": 12,
    "投标文件递交截止时间为": 12,
    "投标文件递交截止时间": 12,
    "投标文件截止时间": 11,
    "投标截止时间": 11,
    "响应文件提交截止时间": 12,
    "提交响应文件截止时间": 12,
    "响应文件截止时间": 11,
    "递交投标文件截止时间": 11,
    "提交投标文件截止时间": 11,
    "递交截止时间": 10,
    "截止时间": 8,
    "开启时间": 3,
    "开标时间": 2,
}
DEADLINE_EXTRA = [(("北京时间",), 1), (("前提交", "提交响应文件"), 2), (("前递交", "递交投标文件"), 2)]
DEADLINE_STARTS = ["投标文件递交的截止时间为", "投标文件递交截止时间为", "投标文件递交截止时间", "投标文件截止时间", "投标截止时间", "响应文件提交截止时间", "提交截止时间", "提交投标文件截止时间", "递交投标文件截止时间", "递交截止时间", "截止时间", "开启时间", "开标时间"]
GENERATED_SCORE = -20

# A day by its characters, digits perhaps spaced, and an ISO day; either with a time.
_DAY = rf"((?:\d{WS}*){{4}}年{WS}*\d{{1,2}}{WS}*月{WS}*\d{{1,2}}{WS}*日(?:{WS}*\d{{1,2}}{WS}*[时点:：]{WS}*\d{{1,2}}(?:{WS}*分)?)?)"
_ISO = rf"(\d{{4}}-\d{{1,2}}-\d{{1,2}}(?:{WS}+\d{{1,2}}:\d{{2}}(?::\d{{2}})?)?)"
_ISO_TIME = rf"(\d{{4}}-\d{{1,2}}-\d{{1,2}}{WS}+\d{{1,2}}:\d{{2}}(?::\d{{2}})?)"
# The look-ahead, from the least to the greatest first character, changes no match but spares the engine most places.
_LABELLED = f"(?=[{min(m[0] for m in DEADLINE_STARTS)}-{max(m[0] for m in DEADLINE_STARTS)}])(?:{'|'.join(DEADLINE_STARTS)})[^0-9]{{0,16}}"
DEADLINES = {
    "labels": DEADLINE_LABELS,
    "extra": DEADLINE_EXTRA,
    "forms": [_DAY, _ISO],
    "phrases": [_LABELLED + _DAY, rf"于{WS}*{_DAY}{WS}*[（(]北京时间[)）]?{WS}*前", _LABELLED + _ISO_TIME],
}


def deadline(body: Column, published: Column, html: Column | None = None) -> Column:
    """The day until which offers are taken: the best labelled day near the publication; the day a page was made comes last."""
    found = dates.deadline_candidates(body, **DEADLINES)
    if html is not None:
        made = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<meta[^>]+name="others"[^>]+content="[^"]*页面生成时间\s*([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})'), F.lit(1))
        found = F.concat(found, F.transform(made, lambda d: F.struct(F.lit(GENERATED_SCORE).alias("score"), dates.parse_cjk_date(d).alias("day"))))
    return bind(found, lambda x: dates.best_deadline(x, published))


#: Every word of the tables above; none but the stops holds a space, so what a text joined of parts holds is what its parts hold.
MARKERS = rules.Markers(
    *(words for t in (SECTORS, ASSETS, SCOPES, MODES, DOMAINS) for words in t.values()),
    *(DISCIPLINE, NEW_BUILD, REFUSED_CATEGORIES, REFUSED_WORDS, DESIGN_WORDS, CONTEXT_WORDS),
    *(TITLE_WEIGHTS, BODY_WEIGHTS, OBJECT_WEIGHTS, CONTEXTUAL_PENALTIES, PENALTIES, SITE_PENALTIES),
)


def found(title: Column, body: Column, category: Column) -> Column:
    """Struct of the markers in the title, in the whole notice, in what stands before the part on bidders and addresses, and in the category."""
    body = F.coalesce(body, F.lit(""))
    parts = F.array(F.lower(F.coalesce(title, F.lit(""))), F.lower(body), F.lower(rules.cut_at_markers(body, STOPS)), F.coalesce(category, F.lit("")))
    named = lambda h: F.struct(h[0].alias("title"), F.array_union(h[0], h[1]).alias("whole"), F.array_union(h[0], h[2]).alias("head"), h[3].alias("category"))
    return bind(F.transform(parts, MARKERS.hits), named)


def features(title: Column, body: Column, category: Column) -> Column:
    """Struct of label arrays: sectors, assets, scopes, modes, domains; and discipline.

    Assets, scopes and modes are read before the part on bidders and addresses; a renovation is no new
    building unless it says so; interior design is an interior."""
    return bind(found(title, body, category), features_of)


def features_of(m: Column) -> Column:
    """features() of the markers found."""
    assets = rules.labels_of(m["head"], ASSETS)

    def settled(scopes: Column, modes: Column) -> Column:
        both = F.array_contains(modes, "new_build") & F.array_contains(modes, "renovation") & ~rules.any_hit(m["head"], NEW_BUILD)
        return F.struct(
            rules.labels_of(m["category"], SECTORS).alias("sectors"),
            F.when(F.array_contains(scopes, "interior_design"), F.array_union(F.array(F.lit("interior")), assets)).otherwise(assets).alias("assets"),
            scopes.alias("scopes"),
            F.when(both, F.array_remove(modes, "new_build")).otherwise(modes).alias("modes"),
            rules.labels_of(F.array_union(m["category"], m["whole"]), DOMAINS).alias("domains"),
            rules.any_hit(m["whole"], DISCIPLINE).alias("discipline"),
        )

    return bind(F.struct(rules.labels_of(m["head"], SCOPES).alias("scopes"), rules.labels_of(m["head"], MODES).alias("modes")), lambda x: settled(x["scopes"], x["modes"]))


def _has(labels: Column, *names: str) -> Column:
    return F.arrays_overlap(labels, F.array(*map(F.lit, names)))


def strong_asset(f: Column) -> Column:
    """An asset that says more than renewal of a quarter."""
    return F.size(F.array_remove(f["assets"], "urban_renewal")) > 0


def building_target(f: Column) -> Column:
    """Decision list over features: whether a notice is for the design of a building."""
    strong, any_asset, support = strong_asset(f), F.size(f["assets"]) > 0, (F.size(f["sectors"]) > 0) | f["discipline"]
    return rules.decide(
        [
            ((F.size(f["domains"]) > 0) & ~strong & ~support, False),
            (F.size(f["scopes"]) == 0, False),
            (strong, True),
            (_has(f["scopes"], "planning") & _has(f["assets"], "land_use_planning"), True),
            (_has(f["scopes"], "architectural_design") & f["discipline"], True),
            ((F.size(f["sectors"]) > 0) & f["discipline"], True),
            (support & any_asset, True),
        ],
        False,
    )


def relevance(title: Column, body: Column, category: Column, detailed: Column) -> Column:
    """Struct (relevant, score): two vetoes with scores of their own, then a sum of weights with a threshold that is
    lower where the detail page was read."""

    def judged(m: Column, f: Column, sums: Column) -> Column:
        whole, things, contextual, site = m["whole"], sums[0], sums[1], sums[2]
        plus = lambda c, w, otherwise=0: F.when(c, F.lit(w)).otherwise(F.lit(otherwise))
        score = rules.weight_of(m["title"], TITLE_WEIGHTS) + rules.weight_of(whole, BODY_WEIGHTS) + things - rules.weight_of(whole, PENALTIES)
        score = score - F.when(contextual > 0, site).otherwise(F.lit(0)) + plus(rules.any_hit(whole, DESIGN_WORDS), 2) + plus(rules.any_hit(whole, CONTEXT_WORDS), 3, -3)
        score = score + plus(F.size(f["sectors"]) > 0, 3) + plus(f["discipline"], 2) + plus(strong_asset(f), 2) - 3 * F.size(f["domains"])
        veto = ((contextual >= 5) & (things == 0)) | ((contextual >= 3) & (site >= things + 3)) | ~building_target(f)
        return bind(score, lambda n: F.struct((~veto & (n >= F.when(detailed, 7).otherwise(10))).alias("relevant"), n.cast("int").alias("score")))

    def weighed(m: Column) -> Column:
        sums = F.array(*(rules.weight_of(m["whole"], t) for t in (OBJECT_WEIGHTS, CONTEXTUAL_PENALTIES, SITE_PENALTIES)))
        scored = bind(features_of(m), lambda f: bind(sums, lambda x: judged(m, f, x)))
        refused = lambda score: F.struct(F.lit(False).alias("relevant"), F.lit(score).alias("score"))
        return F.when(rules.any_hit(m["category"], REFUSED_CATEGORIES), refused(-120)).when(rules.any_hit(m["whole"], REFUSED_WORDS), refused(-100)).otherwise(scored)

    return bind(found(title, body, category), weighed)


def project_types(f: Column) -> Column:
    inside = _has(f["scopes"], "interior_design") | _has(f["assets"], "interior")
    building = strong_asset(f) | f["discipline"] | (F.size(f["sectors"]) > 0)
    return F.array_compact(F.array(F.when(_has(f["assets"], "urban_renewal"), "urban_regeneration"), F.when(_has(f["scopes"], "planning"), "urban_planning"), F.when(inside, "interior_project"), F.when(building, "building_project")))


def building_categories(f: Column) -> Column:
    a = f["assets"]
    return F.array_compact(F.array(F.when(_has(a, "healthcare"), "healthcare"), F.when(_has(a, "education"), "education"), F.when(_has(a, "housing"), "housing"), F.when(_has(a, "civic_culture", "welfare", "office_research"), "civic_public"), F.when(_has(a, "hospitality_commercial"), "sport_leisure")))


def competition_types(f: Column) -> Column:
    a = f["assets"]
    inside = _has(f["scopes"], "interior_design") | _has(a, "interior")
    return F.array_compact(F.array(F.lit("architecture"), F.when(inside, "interior"), F.when(_has(a, "healthcare"), "healthcare"), F.when(_has(a, "education"), "education"), F.when(_has(a, "housing"), "housing"), F.when(_has(a, "civic_culture", "welfare", "office_research"), "public_building"), F.when(_has(a, "urban_renewal") | _has(f["modes"], "renovation"), "adaptive_reuse"), F.when(_has(f["scopes"], "planning"), "masterplan")))
