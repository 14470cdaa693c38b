"""Word lists, header aliases, label tables and scoring constants.

Results are only comparable when these values agree exactly, so they are kept together
here as plain data and nothing in this file computes anything.
"""

# --- fixed values: header aliases, first alias with a value wins -----------------------
HEADER_ALIASES = {
    "id": ["id"],
    "name": ["name", "nombre", "productname", "product", "title"],
    "description": ["description", "descripcion", "desc"],
    "category": ["category", "categoria", "niche", "segment"],
    "category_path": ["category_path", "categorypath", "path"],
    "price": ["price", "precio", "cost", "unitprice"],
    "currency": ["currency", "moneda"],
    "image_url": [
        "image_url", "image", "imagen", "img", "imgurl", "picture", "imageurl",
        "imagelink", "mainimage", "mainimageurl",
    ],
    "desire": ["desire", "deseo"],
    "desire_magnitude": ["desire_magnitude", "desiremag", "magnituddeseo"],
    "awareness_level": ["awareness_level", "awareness", "nivelconsciencia"],
    "competition_level": ["competition_level", "competition", "saturacionmercado"],
    "date_range": ["date_range", "daterange", "rangofechas", "fecharango"],
    "launch_date": ["launch_date", "launchdate", "fechalanzamiento"],
    "rating": ["rating", "valoracion", "stars", "productrating"],
    "units_sold": ["units_sold", "unitssold", "units", "itemsold", "items_sold", "sold"],
    "revenue": ["revenue", "sales", "ingresos"],
    "conversion_rate": [
        "conversion_rate", "conversion", "tasaconversion", "cr", "conversionrate",
    ],
    "winner_score": ["winner_score", "winnerscore"],
    "source": ["source", "fuente"],
    "brand": ["brand", "marca", "seller"],
    "asin": ["asin", "productasin", "asin13"],
    "url": [
        "url", "producturl", "product_url", "link", "productlink", "landingpage",
        "landing_page", "landingpageurl", "landing_page_url",
    ],
}

# --- fixed values: substring header patterns, in the order fields claim their column ---
HEADER_PATTERNS = {
    "rating": ["rating", "stars", "valoracion", "puntuacion"],
    "units_sold": ["unitssold", "units", "ventas", "sold"],
    "revenue": ["revenue", "sales", "ingresos"],
    "conversion_rate": ["conversion", "cr", "tasaconversion"],
    "launch_date": ["launchdate", "fecha", "date", "firstseen"],
    "date_range": ["daterange", "fecharango", "rangofechas"],
    "price": ["price", "precio", "cost", "unitprice"],
    "image_url": [
        "imageurl", "image", "imagelink", "mainimage", "mainimageurl", "img", "imagen",
        "picture", "primaryimage",
    ],
    "name": ["name", "productname", "title", "product", "producto"],
    "description": ["description", "descripcion", "desc"],
    "category": ["category", "categoria", "niche", "segment"],
    "currency": ["currency", "moneda"],
}

# --- fixed values: legacy metric columns ----------------------------------------------
LEGACY_METRICS = [
    "magnitud_deseo",
    "nivel_consciencia_headroom",
    "evidencia_demanda",
    "tasa_conversion",
    "ventas_por_dia",
    "recencia_lanzamiento",
    "competition_level_invertido",
    "facilidad_anuncio",
    "escalabilidad",
    "durabilidad_recurrencia",
]
LEGACY_NUMERIC = [
    "evidencia_demanda",
    "tasa_conversion",
    "ventas_por_dia",
    "recencia_lanzamiento",
]
LEGACY_CATEGORY_VALUES = {
    "magnitud_deseo": {"low": 0.33, "medium": 0.66, "high": 1.0},
    "nivel_consciencia_headroom": {
        "unaware": 1.0, "problem": 0.8, "solution": 0.6, "product": 0.4, "most": 0.2,
    },
    "competition_level_invertido": {"low": 1.0, "medium": 0.5, "high": 0.0},
    "facilidad_anuncio": {"low": 0.33, "med": 0.66, "medium": 0.66, "high": 1.0},
    "escalabilidad": {"low": 0.33, "med": 0.66, "medium": 0.66, "high": 1.0},
    "durabilidad_recurrencia": {"consumible": 1.0, "durable": 0.0, "intermedio": 0.5},
}

# --- fixed values: rubric fields -------------------------------------------------------
RUBRIC_FIELDS = [
    "magnitud_deseo",
    "nivel_consciencia",
    "saturacion_mercado",
    "facilidad_anuncio",
    "facilidad_logistica",
    "escalabilidad",
    "engagement_shareability",
    "durabilidad_recurrencia",
]
# metric column -> (rubric field, larger is worse)
RUBRIC_FROM_METRIC = {
    "orders": ("magnitud_deseo", False),
    "sellers": ("saturacion_mercado", True),
    "weight": ("facilidad_logistica", True),
}

# --- fixed values: weighted score ------------------------------------------------------
SCORE_FIELDS = [
    "price", "rating", "units_sold", "revenue", "desire", "competition", "oldness",
    "awareness",
]
DEFAULT_ORDER = [
    "awareness", "desire", "revenue", "competition", "units_sold", "price", "oldness",
    "rating",
]
AWARENESS_STAGES = [
    "unaware", "problem aware", "solution aware", "product aware", "most aware",
]
AWARENESS_CENTRES = [10, 30, 50, 70, 90]
DESIRE_LABEL_VALUES = {"low": 0.2, "medium": 0.5, "med": 0.5, "high": 0.8}
COMPETITION_LABEL_VALUES = {"low": 0.8, "medium": 0.5, "med": 0.5, "high": 0.2}
SUB_SCORES = [
    "momentum", "saturation", "differentiation", "social_proof", "margin", "logistics",
]

# --- fixed values: weights from a metric profile ---------------------------------------
PROFILE_BASE_WEIGHTS = {
    "price": 34.0,
    "rating": 62.0,
    "units_sold": 74.0,
    "revenue": 78.0,
    "desire": 60.0,
    "competition": 46.0,
    "oldness": 42.0,
    "awareness": 54.0,
}
PROFILE_PREFERENCE = {
    "price": "mid",
    "rating": "high",
    "units_sold": "high",
    "revenue": "high",
    "desire": "high",
    "competition": "low",
    "oldness": "low",
    "awareness": "mid",
}
NOTE_NO_PROFILE = "sin agregados: no se pueden fijar pesos sin inventar"
NOTE_NO_DATA = "%s: sin datos en agregados"
NOTE_CROWDED = "competition: promedio alto, peso moderado"
NOTE_LOW_COVERAGE = "%s: cobertura baja (%.2f)"
CORRELATION_FALLBACK_PROFILE = {
    "revenue": 80, "units_sold": 70, "rating": 60, "price": 55, "desire": 45,
    "competition": 35, "oldness": 25, "awareness": 15,
}
SUCCESS_METRICS = ["orders", "revenue", "gmv", "sales", "units"]

# --- fixed values: labels --------------------------------------------------------------
TRI_LEVELS = ["Low", "Medium", "High"]
AWARENESS_LABELS = [
    "Unaware", "Problem-Aware", "Solution-Aware", "Product-Aware", "Most Aware",
]
EXPORT_AWARENESS_LABELS = [
    "Unaware", "Problem-aware", "Solution-aware", "Product-aware", "Most aware",
]
TRI_SYNONYMS = {
    "low": "Low",
    "baja": "Low",
    "medium": "Medium",
    "medio": "Medium",
    "med": "Medium",
    "high": "High",
    "alta": "High",
}
AWARENESS_SYNONYMS = {
    "unaware": "Unaware",
    "problemaware": "Problem-Aware",
    "problemaaware": "Problem-Aware",
    "problemaconsciente": "Problem-Aware",
    "solutionaware": "Solution-Aware",
    "solucionaware": "Solution-Aware",
    "solucionconsciente": "Solution-Aware",
    "productaware": "Product-Aware",
    "productoaware": "Product-Aware",
    "productoconciente": "Product-Aware",
    "mostaware": "Most Aware",
    "masaware": "Most Aware",
    "masconsciente": "Most Aware",
    "muyaware": "Most Aware",
}

# --- fixed values: text ----------------------------------------------------------------
NAME_STOP_WORDS = [
    "the", "and", "de", "la", "el", "y", "a", "para", "por", "con", "sin", "en", "un",
    "una", "los", "las", "lo", "al", "del",
]
KEYWORD_STOP_WORDS = [
    "the", "and", "for", "with", "a", "an", "de", "la", "el", "para", "y", "con", "un",
    "una", "los", "las", "en", "por", "to", "of",
]
KEYWORD_LETTERS = "a-záéíóúüñ0-9"
UNIT_WORDS = ["ml", "l", "litros", "w", "kw", "cm", "mm", "kg", "lbs", "oz", "pulgadas"]
CATEGORY_WORDS = [
    "crema", "champ[uú]", "ser[úu]m", "t[oó]nico", "jab[oó]n", "cepillo", "plancha",
    "secador", "aspiradora", "colch[oó]n", "cuchillos?", "maquin[ae]", "parches?",
    "figura", "vinilo", "litter", "box", "shampoo", "conditioner", "brush", "knife",
    "set", "kit", "pack",
]
PACK_WORDS = ["set", "kit", "pack"]
VARIANT_WORDS = (
    r"\b(black|white|blue|red|green|yellow|pink|purple|brown|grey|gray|"
    r"rojo|azul|verde|negro|blanco|gris|marr[oó]n|rosa|morado|amarillo|"
    r"talla\s?[smlx]+|size\s?[smlx]+|xl|xxl|xs|s|m|l|xxs|xxxl|"
    r"\d+\s?(cm|mm|in|inch|pcs|pack|ud|uds))\b"
)
VARIANT_KEY_LENGTH = 24
PRICE_PATTERNS = [
    r"€\s*(\d+[\.,]\d+)",
    r"\$(\d+[\.,]\d+)",
    r"(\d+[\.,]\d+)\s*€",
    r"(\d+[\.,]\d+)\s*USD",
]
FLAME = "\U0001F525"
MISSING_WORDS = ["na", "n/a", "none", "null"]

# --- fixed values: failure codes, first rule that matches wins -------------------------
# (code, retryable, groups of substrings: every group must have a hit)
FAILURE_RULES = [
    ("auth.missing_api_key", False, [["missing_api_key", "api key"]]),
    ("quota.cost_cap_reached", False, [["cost_cap", "cost cap", "budget"]]),
    ("remote.rate_limited", True, [["rate limit", "429", "too many requests"]]),
    ("remote.timeout", True, [["timeout", "timed out"]]),
    ("remote.network_error", True, [["connection", "network", "ssl", "handshake", "dns"]]),
    ("response.invalid_json", True, [["invalid"], ["json"]]),
    ("auth.unauthorized", False, [["unauthorized", "401"]]),
    ("auth.forbidden", False, [["forbidden", "403"]]),
    ("remote.not_found", False, [["not found", "404"]]),
    ("data.missing_ai_output", True, [["missing"]]),
    (
        "remote.server_error",
        True,
        [["500", "502", "503", "504", "server error", "bad gateway"]],
    ),
]
FAILURE_EMPTY = ("ko.unknown", True)
FAILURE_OTHER = ("ko.unclassified", True)

# what each code means to a user, and what to do about it
FAILURE_TEXTS = {
    "auth.missing_api_key": ("No key for the model service is set.", "Set a key and start the job again."),
    "quota.cost_cap_reached": ("The spending limit of the job is used up.", "Raise the limit or wait for the next period."),
    "remote.rate_limited": ("The service turned requests away as too frequent.", "Send fewer or smaller batches and retry later."),
    "remote.timeout": ("No answer came within the time limit.", "Retry, or allow more time per request."),
    "remote.network_error": ("The service could not be reached.", "Check the network path and certificates, then retry."),
    "response.invalid_json": ("The answer was not readable JSON.", "Retry with smaller batches; check the asked format."),
    "auth.unauthorized": ("The service did not accept the key.", "Check that the key is valid for this model."),
    "auth.forbidden": ("The account may not use this model.", "Ask for access or choose another model."),
    "remote.not_found": ("The address or the model does not exist.", "Correct the model name or the address."),
    "data.missing_ai_output": ("The answer left out some of the asked products.", "Retry those products; look at their texts if it recurs."),
    "remote.server_error": ("The service failed on its side.", "Retry after a pause."),
    "ko.unknown": ("The failure came without a reason.", "Look into the log of the job and run it again."),
    "ko.unclassified": ("The reason fits no known kind of failure.", "Look into the log of the job and the rows sent."),
}

# --- fixed values: export columns and their source keys --------------------------------
EXPORT_TABLE_COLUMNS = [
    "id", "name", "Winner Score", "Desire", "Desire Magnitude", "Awareness Level",
    "Competition Level", "Date Range",
]
EXPORT_TEXT_KEYS = {
    "name": ["name", "product_name", "title"],
    "tiktok_url": [
        "tiktok_url", "TikTokUrl", "tiktokurl", "tiktok", "tiktok link", "TikTok URL",
        "TikTok Url",
    ],
    "kalodata_url": ["kalodata_url", "KalodataUrl", "kalodataurl", "Kalodata URL"],
    "img_url": [
        "image_url", "image", "img_url", "img", "imageurl", "imagelink", "Img_url", "Img Url",
    ],
    "category": ["category", "category_path", "Category"],
    "launch_date": ["launch_date", "Launch Date", "launchdate"],
    "desire": ["desire", "desires", "customer_desire", "desire_text", "ai_desire_label"],
    "desire_magnitude": ["desire_magnitude", "desiremag", "desire_mag"],
    "desire_score": ["desire_score", "_desire_score", "ai_desire_score"],
    "awareness_level": [
        "awareness_level_label", "awareness_level", "awareness", "awareness_score",
    ],
    "competition_level": [
        "competition_level_label", "competition_level", "competition", "competition_score",
    ],
}
EXPORT_NUMBER_KEYS = {
    "price": ["price", "Price($)", "price$", "price_usd"],
    "rating": ["rating", "Product Rating", "productrating"],
    "items_sold": ["units_sold", "items_sold", "Item Sold", "sold"],
}
EXPORT_REVENUE_KEYS = [
    ["revenue", "Revenue($)", "total_revenue"],
    ["live_revenue", "Live Revenue($)", "live revenue"],
    ["video_revenue", "Video Revenue($)", "video revenue"],
    ["shopping_mall_revenue", "Shopping Mall Revenue($)", "shopping mall revenue"],
]
EXPORT_COLUMN_ORDER = [
    "image preview", "name", "category", "launch date", "price", "rating", "revenue",
    "items sold", "desire", "desire magnitude", "awareness level", "competition level",
    "TikTokUrl", "KalodataUrl", "Img_url",
]
# accepted headers of each report column, the first one present is taken
EXPORT_HEADER_SYNONYMS = {
    "image preview": [
        "image preview", "image_preview", "preview image", "thumbnail", "miniatura", "img",
        "product image", "image url", "image_url", "img_url", "imagen", "image",
    ],
    "name": ["name", "title", "product name", "nombre", "producto"],
    "category": ["category", "categories", "categoria", "categoría"],
    "launch date": [
        "launch date", "launch_date", "launched at", "launched_at", "release date",
        "release_date", "first seen", "first_seen", "fecha de lanzamiento",
        "fecha lanzamiento", "date launched", "launchdate",
    ],
    "price": ["price", "precio", "price($)", "price usd", "price$"],
    "rating": ["rating", "rate", "stars", "product rating", "valoración", "valoracion"],
    "revenue": ["revenue", "total revenue", "total revenue($)", "income", "ingresos"],
    "items sold": [
        "items sold", "units_sold", "units sold", "item sold", "sold", "unidades vendidas",
    ],
    "desire": ["desire", "desires"],
    "desire magnitude": [
        "desire magnitude", "desire_magnitude", "desire mag", "desire_mag",
        "magnitud del deseo",
    ],
    "awareness level": [
        "awareness level", "awareness", "nivel de awareness", "nivel awareness",
    ],
    "competition level": ["competition level", "competition", "nivel de competencia"],
}
# back-filled spellings of recognised extras: typed key -> display key
EXTRA_DISPLAY_KEYS = {
    "rating": "Product Rating",
    "units_sold": "Item Sold",
    "revenue": "Revenue($)",
    "conversion_rate": "Creator Conversion Ratio",
    "launch_date": "Launch Date",
}
DATE_RANGE_KEYS = [
    "date_range", "rango_fechas", "Date Range", "Date range", "Rango Fechas", "dateRange",
    "rangoFechas",
]
FIRST_SEEN_KEYS = [
    "first_seen", "first_seen_at", "first_date", "first_seen_date", "firstSeen",
    "firstSeenAt", "First Seen", "First seen", "First Date",
]
LAST_SEEN_KEYS = [
    "last_seen", "last_seen_at", "last_date", "last_seen_date", "lastSeen", "lastSeenAt",
    "Last Seen", "Last seen", "Last Date",
]
MODEL_FIELDS = ["desire", "desire_magnitude", "awareness_level", "competition_level"]
PROTECTED_LISTS = ["todos", "all"]
DURATION_BUCKETS = [10, 25, 50, 100, 250, 500]
