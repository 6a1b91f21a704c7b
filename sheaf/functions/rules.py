"""Fixed rules and vocabularies of the gates."""

from __future__ import annotations

# Stage -> (allowed keywords, blocked keywords), in order; "default" allows everything.
STAGES = {
    "land preparation": (
        ("soil preparation", "tillage", "ploughing", "levelling", "soil testing", "drainage", "irrigation setup", "organic matter", "green manure", "lime application"),
        ("harvesting", "post-harvest", "grain filling", "flowering", "fruit development", "maturity", "pest spray at harvest", "yield estimation", "storage"),
    ),
    "nursery sowing": (
        ("seed treatment", "nursery management", "germination", "seedbed preparation", "damping off", "nursery fertilizer", "seed rate", "seed selection"),
        ("harvesting", "post-harvest", "grain filling", "transplanting advice", "maturity", "fruit development", "storage", "yield estimation"),
    ),
    "transplanting": (
        ("transplanting", "spacing", "seedling", "root establishment", "irrigation after transplant", "weed control early", "gap filling", "starter fertilizer"),
        ("harvesting", "post-harvest", "grain filling", "maturity", "fruit development", "storage", "yield estimation"),
    ),
    "vegetative growth": (
        ("nitrogen fertilizer", "weed management", "irrigation", "leaf area", "canopy management", "intercropping", "growth regulators", "top dressing", "pest monitoring"),
        ("harvesting", "post-harvest", "grain filling", "maturity", "storage", "yield estimation", "fruit thinning"),
    ),
    "flowering": (
        ("pollination", "micronutrients", "boron application", "flower drop prevention", "irrigation at flowering", "pest control at flowering", "phosphorus", "potassium"),
        ("harvesting", "post-harvest", "storage", "nursery sowing", "land preparation", "transplanting", "yield estimation", "grain drying"),
    ),
    "fruit development": (
        ("potassium fertilizer", "calcium application", "fruit set", "irrigation for fruit fill", "fruit borer control", "thinning", "size improvement", "color development"),
        ("harvesting", "post-harvest", "storage", "nursery sowing", "land preparation", "grain drying"),
    ),
    "grain filling": (
        ("potassium", "irrigation at grain fill", "foliar spray", "pest control", "disease monitoring", "lodging prevention"),
        ("harvesting", "post-harvest", "storage", "nursery sowing", "land preparation", "transplanting"),
    ),
    "maturity": (
        ("maturity indicators", "moisture content", "harvest readiness", "pre-harvest interval", "desiccation", "stopping irrigation"),
        ("nursery sowing", "land preparation", "transplanting", "vegetative fertilizer", "nitrogen top dressing", "flowering advice", "fruit set"),
    ),
    "harvesting": (
        ("harvesting", "cutting", "threshing", "combine harvester", "harvest loss", "timing of harvest", "moisture at harvest", "yield estimation", "post-harvest handling"),
        ("nursery sowing", "land preparation", "transplanting", "nitrogen fertilizer", "growth regulators", "flowering advice", "fruit set", "pollination"),
    ),
    "post-harvest": (
        ("storage", "drying", "milling", "grading", "packaging", "cold storage", "fumigation", "market price", "soil health restoration", "residue management"),
        ("fertilizer application", "pest spray", "irrigation scheduling", "flowering advice", "fruit development", "nursery sowing"),
    ),
    "monsoon planting": (
        ("seed treatment", "planting", "spacing", "basal fertilizer", "drainage management", "waterlogging prevention", "monsoon pest alert", "green manure"),
        ("harvesting", "post-harvest", "storage", "maturity", "grain drying", "yield estimation"),
    ),
    "monsoon fertilization": (
        ("organic fertilizer", "PGPR", "potassium", "micronutrients", "split application", "fertigation", "soil moisture based application", "monsoon irrigation management", "pest alert monsoon"),
        ("harvesting", "post-harvest", "storage", "nursery sowing", "grain drying", "yield estimation"),
    ),
    "pre-monsoon fertilization": (
        ("pre-monsoon soil preparation", "basal dose", "organic manure", "lime application", "soil testing", "irrigation before monsoon"),
        ("harvesting", "post-harvest", "storage", "grain drying"),
    ),
    "dry season management": (
        ("irrigation", "mulching", "drought management", "water conservation", "soil moisture retention", "shade management", "drip irrigation"),
        ("harvesting", "monsoon pest", "waterlogging", "nursery sowing in rain", "grain drying"),
    ),
    "default": (
        (),
        (),
    ),
}

# Crop -> stages of the twelve months, January first.
CALENDAR = {
    "rice": ("harvesting", "land preparation", "land preparation", "nursery sowing", "nursery sowing", "transplanting", "vegetative growth", "vegetative growth", "flowering", "grain filling", "maturity", "harvesting"),
    "tomato": ("harvesting", "harvesting", "land preparation", "nursery sowing", "transplanting", "vegetative growth", "flowering", "fruit development", "harvesting", "land preparation", "nursery sowing", "transplanting"),
    "coconut": ("dry season management", "dry season management", "pre-monsoon fertilization", "pre-monsoon fertilization", "pre-monsoon irrigation", "monsoon planting", "monsoon fertilization", "monsoon fertilization", "post-monsoon care", "post-monsoon care", "harvesting", "harvesting"),
    "wheat": ("flowering", "grain filling", "maturity", "harvesting", "land preparation", "fallow", "fallow", "fallow", "fallow", "land preparation", "sowing", "vegetative growth"),
    "cotton": ("harvesting", "harvesting", "land preparation", "sowing", "vegetative growth", "squaring", "flowering", "boll development", "boll opening", "harvesting", "harvesting", "land preparation"),
    "default": ("winter dormancy or harvesting", "land preparation", "sowing season", "vegetative growth", "vegetative growth", "monsoon onset", "active growth", "active growth", "flowering or fruiting", "maturity", "harvesting", "post-harvest"),
}

# Fixed values: (crop, season) -> alerts.
PESTS = {
    ("rice", "monsoon"): ("Brown Plant Hopper (BPH) risk HIGH — apply Buprofezin 25SC @ 1ml/L", "Blast disease risk — apply Tricyclazole 75WP @ 0.6g/L at tillering"),
    ("rice", "summer"): ("Stem borer active — use pheromone traps", "Leaf folder risk — apply Chlorpyriphos 2.5ml/L"),
    ("rice", "winter"): ("Sheath blight risk during cool humid nights — monitor closely",),
    ("tomato", "monsoon"): ("Late blight (Phytophthora) HIGH risk — apply Mancozeb 2.5g/L", "Fruit borer active — use Bacillus thuringiensis spray"),
    ("tomato", "summer"): ("Whitefly and TYLCV risk — use yellow sticky traps + Imidacloprid 0.3ml/L", "Thrips infestation likely — apply Spinosad 0.5ml/L"),
    ("tomato", "winter"): ("Damping off risk in nursery — drench with Captan 2g/L",),
    ("coconut", "monsoon"): ("Rhinoceros beetle activity HIGH — use pheromone traps in trunk", "Bud rot risk — apply Bordeaux mixture 1% at crown"),
    ("coconut", "summer"): ("Red palm weevil alert — inspect trunk regularly", "Leaf caterpillar active — apply Carbaryl 0.1%"),
    ("coconut", "winter"): ("Eriophyid mite risk in dry cool weather — apply Wettable Sulphur 3g/L",),
    ("wheat", "monsoon"): ("Karnal bunt risk — use certified disease-free seed",),
    ("wheat", "summer"): ("Aphid infestation — apply Dimethoate 1.5ml/L",),
    ("wheat", "winter"): ("Yellow rust HIGH risk in cool humid conditions — apply Propiconazole 1ml/L", "Termite damage — apply Chlorpyriphos to soil before sowing"),
    ("default", "monsoon"): ("High humidity — general fungal disease risk elevated. Monitor crops daily.",),
    ("default", "summer"): ("Heat stress — ensure adequate irrigation. Watch for sucking pests.",),
    ("default", "winter"): ("Cool dry conditions — watch for mites and powdery mildew.",),
}

# Registry key | base score | year, in order, and decay constants by query type.
FRESHNESS = (("TNAU", 0.95, 2022), ("KAU", 0.90, 2019), ("UAS Bangalore", 0.88, 2021), ("ANGRAU", 0.87, 2020), ("Crop Protection", 0.85, 2018), ("ICAR", 0.92, 2023))
DECAY = {"FACTUAL": 0.03, "RECOMMENDATION": 0.10, "DIAGNOSTIC": 0.07, "PROCEDURAL": 0.05}
OTHER_DECAY = 0.05
EVALUATION_YEAR = 2025
LEAST_FRESHNESS = 0.55

# Weather keywords, location patterns in order, the default location.
WEATHER_WORDS = (
    "weather", "rain", "rainfall", "irrigation today", "spray today", "fertilize today", "harvest today", "temperature", "humidity", "monsoon", "drought",
    "flood", "should i water", "should i spray", "tomorrow", "this week", "forecast", "climate today",
)
LOCATIONS = (
    r"in ([A-Z][a-z]+(?: [A-Z][a-z]+)*)",
    r"at ([A-Z][a-z]+(?: [A-Z][a-z]+)*)",
    r"near ([A-Z][a-z]+(?: [A-Z][a-z]+)*)",
    r"([A-Z][a-z]+(?:,\s*[A-Z][a-z]+)*) farm",
    r"([A-Z][a-z]+(?:,\s*[A-Z][a-z]+)*) district",
)
DEFAULT_LOCATION = "Coimbatore, Tamil Nadu"
# Weather codes.
WEATHER_CODES = {
    0: "Clear sky", 1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Foggy", 48: "Icy fog", 51: "Light drizzle", 53: "Drizzle", 55: "Heavy drizzle",
    61: "Slight rain", 63: "Moderate rain", 65: "Heavy rain", 71: "Slight snow", 73: "Moderate snow", 75: "Heavy snow", 80: "Slight showers", 81: "Moderate showers",
    82: "Heavy showers", 95: "Thunderstorm", 96: "Thunderstorm with hail",
}

CROP_NAMES = tuple(c for c in CALENDAR if c != "default")
