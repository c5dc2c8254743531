"""Vocabularies and labels. All of these are fixed values that results must equal."""

STATUS_LABELS = {"discovered": "Discovered", "shortlisted": "Shortlisted", "verified": "Verified", "archived": "Archived", "discarded": "Discarded"}
OPPORTUNITY_TYPE_LABELS = {
    "public_design_contest": "Public design contest",
    "public_design_services_procurement": "Public design services procurement",
    "framework_design_services": "Framework design services",
    "negotiated_follow_on_services": "Negotiated follow-on services",
}
PROCEDURE_LABELS = {
    "design_contest": "Design contest",
    "negotiated_procedure_after_contest": "Negotiated procedure after contest",
    "public_design_services_tender": "Public design services tender",
    "maitrise_d_oeuvre_procurement": "Maitrise d oeuvre procurement",
    "planning_competition": "Planning competition",
    "selective": "Selective procedure",
    "framework_agreement": "Framework agreement",
    "negotiated_procedure": "Negotiated procedure",
    "adapted_procedure": "Adapted procedure",
    "open": "Open procedure",
    "neg-w-call": "Negotiated procedure with call",
    "neg-wo-call": "Negotiated procedure without call",
}
IMPLEMENTATION_LABELS = {
    "winner_or_winners_progress_to_negotiated_service_award": "Winner or winners progress to negotiated service award",
    "service_contract_award_after_competitive_selection": "Service contract award after competitive selection",
    "framework_selection_for_repeated_design_commissions": "Framework selection for repeated design commissions",
}
EVIDENCE_LABELS = {"official_notice": "Official notice", "official_listing": "Official listing", "authority_page": "Authority page", "secondary": "Secondary source", "tertiary": "Tertiary source"}
PROJECT_TYPES = ["urban_regeneration", "environment_design", "urban_planning", "interior_project", "building_project"]
BUILDING_CATEGORIES = ["education", "healthcare", "housing", "civic_public", "sport_leisure", "culture_heritage", "transport_infrastructure"]
DESIGN_SCOPES = ["interior_design", "architectural_design", "scheme", "preliminary", "construction_docs", "planning", "design_service"]
PROJECT_MODES = ["new_build", "renovation", "extension"]
PROCEDURE_ALIASES = {
    "design_contest": ["design_contest", "project_competition"],
    "planning_competition": ["planning_competition"],
    "selective": ["selective"],
    "maitrise_d_oeuvre_procurement": ["maitrise_d_oeuvre_procurement", "maitrise_doeuvre_procurement"],
    "public_design_services_tender": ["public_design_services_tender", "ANNOUNCEMENT_OF_COMPETITION", "request_for_proposals", "request_for_tender", "request_for_quotes", "official_procurement_notice", "authority_profile_notice", "anac_public_notice", "Avviso", "P1"],
    "framework_agreement": ["framework_agreement", "framework"],
    "open": ["open", "open_procedure", "Offenes Verfahren", "Procédure Ouverte", "Competitive - Open bidding", "Open procedure (above threshold)", "Open procedure (below threshold)", "Abierto", "UVgO/VgV, Offenes Verfahren"],
    "negotiated_procedure": ["negotiated_procedure", "Procédure Négociée"],
    "adapted_procedure": ["adapted_procedure", "Procédure Adaptée"],
    "neg-w-call": ["neg-w-call", "Verhandlungsverfahren mit Teilnahmewettbewerb"],
    "neg-wo-call": ["neg-wo-call", "Single tender action (below threshold)"],
}
SUPPRESSED_PROCEDURES = ["secondary_discovery_listing", "AD3", "Altri avvisi"]
OPPORTUNITY_TYPE_ALIASES = {
    "public_design_contest": ["public_design_contest", "design_contest", "competition", "project_competition", "planning_competition"],
    "public_design_services_procurement": ["public_design_services_procurement", "public_design_services_tender"],
    "framework_design_services": ["framework_design_services", "framework_agreement"],
    "negotiated_follow_on_services": ["negotiated_follow_on_services"],
    "unknown": ["unknown"],
}
CATEGORY_WORDS = {
    "education": ["school", "schule", "scuola", "ecole", "college", "grundschule", "groupe scolaire", "campus scolaire"],
    "healthcare": ["hospital", "clinic", "clinique", "ospedale", "ospedal", "healthcare", "medical"],
    "housing": ["housing", "logement", "wohn", "wohnung", "residential", "residenziale"],
    "civic_public": ["library", "bibliothe", "town hall", "mairie", "rathaus", "feuerwache", "community centre", "community center", "begegnungszentrum", "cimiter", "cemeter"],
    "sport_leisure": ["sport", "sportif", "sportivo", "stadium", "arena", "leisure", "loisir", "loisirs", "complexe sportif"],
    "culture_heritage": ["archaeolog", "museum", "heritage", "patrimoine", "restoration", "restauro", "monument", "sanctuary"],
    "transport_infrastructure": ["rail", "station", "tunnel", "bridge", "underbridge", "tram", "metro", "bahn", "transport", "passenger access"],
}
CATEGORY_TYPES = {"education": "education", "healthcare": "healthcare", "housing": "housing", "civic_public": "public_building"}
PROJECT_WORDS = {
    "urban_regeneration": ["urban regeneration", "rigenerazione urbana", "renouvellement urbain", "adaptive reuse", "historic center", "centro storico"],
    "environment_design": ["landscape", "public realm", "park", "garden", "plaza", "square", "waterfront"],
    "urban_planning": ["masterplan", "planning", "piano regolatore", "urban plan", "stadtebau", "urbanisme"],
    "interior_project": ["interior", "interiors", "fit out", "fit-out", "refit", "室内", "精装修", "公区", "软装"],
}
PROJECT_TYPES_BY_COMPETITION = {
    "urban_regeneration": ["adaptive_reuse"],
    "environment_design": ["landscape"],
    "urban_planning": ["masterplan", "urban_design"],
    "interior_project": ["interior"],
    "building_project": ["architecture", "public_building", "healthcare", "education", "housing", "infrastructure", "built_work", "interior"],
}
COMPETITION_WORDS = {
    "public_building": ["library", "civic", "public building", "公共建筑", "图书馆", "文化中心", "办公楼", "综合体", "景区"],
    "urban_design": ["square", "urban", "public space", "masterplan", "城市设计", "公共空间"],
    "landscape": ["landscape", "park", "garden", "plaza", "景观", "园林"],
    "healthcare": ["hospital", "healthcare", "clinic", "医院", "医疗", "卫生院"],
    "education": ["school", "campus", "education", "学校", "教学楼", "校园", "幼儿园"],
    "housing": ["housing", "residential", "老旧小区", "住宅", "小区", "安置房", "安置片区"],
    "interior": ["interior", "interiors", "室内", "精装修", "公区精装"],
    "adaptive_reuse": ["adaptive reuse", "reuse", "conversion", "城市更新", "更新改造", "老旧小区改造", "旧改"],
    "masterplan": ["masterplan", "planning", "规划", "修建性详细规划", "总体规划"],
    "architecture": ["design", "architecture", "architect", "建筑设计", "设计服务", "方案设计", "初步设计", "建筑方案"],
}
ARCHITECT_WORDS = ["architect registration", "architecte", "architect", "architettura", "architetto", "licensed architect", "architectural and related services", "architectural, engineering and planning services", "servizi di architettura e ingegneria", "progettazione", "maitrise d'oeuvre", "maîtrise d'oeuvre", "iscritto", "qualification required", "general planners", "注册建筑师", "一级注册建筑师", "设计资质", "建筑行业", "建筑工程", "工程设计综合甲级", "建筑装饰工程设计专项甲级"]
PARTNER_WORDS = ["local partner", "local engineering", "local permitting partner", "local teaming", "teaming partner", "joint venture", "consortium"]
POSITIVE_WORDS = ["architect", "architecture", "architett", "architecte", "architectural", "progettazione", "maitrise d oeuvre", "maitrise d ouvrage", "masterplan", "urban design", "landscape", "planungswettbewerb", "projektwettbewerb", "design competition", "project competition", "concours", "competition", "design services"]
NEGATIVE_WORDS = ["student", "students", "workshop", "award", "poster", "logo", "photography", "graphic design", "stationery", "cancelleria", "printing", "stampa", "grafica", "sito web", "website", "bollettazione", "depurazione", "rilevazione incendi", "impianti elettrici", "wayfinding", "segnaletica", "testvergabe", "dies ist eine testvergabe", "bitte weder bewerben"]
BUILT_WORDS = ["building", "civic", "library", "museum", "school", "college", "campus", "hospital", "housing", "public space", "urban", "waterfront", "landscape", "masterplan", "rehabilitation", "renovation", "extension", "biblioteca", "scuola", "museo", "ospedale", "edificio", "piazza", "urbanistica", "riqualificazione", "rigenerazione", "civico", "logement", "architecture"]
RELEVANT_CODES = ("712", "7142")
CONFLICT_WORDS = ["conflict", "mismatch", "disagree", "official source wins", "official notice wins"]
