"""Parameters given as text or left out: clamps, defaults, estimates of cost."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, functions as F

from .geo import valid_coordinate

#: Megabytes of graphics memory by crops, and what the formula beyond them adds to.
MEMORY_MB = ((1, 4608), (2, 5632), (4, 7168), (6, 8704), (8, 10240), (10, 12800))
MEMORY_BASE_MB, MEMORY_LIMIT_MB = 4096, 12_288


def limit(text: Column, default: int, most: int) -> Column:
    """A whole number of 1 to most; the default for no number."""
    x = F.trim(text).try_cast("double")
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.coalesce(F.when(F.abs(x) < float("inf"), F.least(F.greatest(whole, F.lit(1)), F.lit(most))), F.lit(default)).cast("int")


def ratio(text: Column, default: float) -> Column:
    """A number held to 0 to 1; the default for no number."""
    x = F.trim(text).try_cast("double")
    return F.coalesce(F.when(F.abs(x) < float("inf"), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))), F.lit(default))


def boolean(text: Column, default: bool) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False).otherwise(default)


def radius(text: Column, default: float, least: float = 0.2, most: float = 6.0) -> Column:
    """A number held to its bounds; the default for nothing or no number."""
    x = F.trim(text).try_cast("double")
    return F.coalesce(F.when((text != "") & (F.abs(x) < float("inf")), F.least(F.greatest(x, F.lit(least)), F.lit(most))), F.lit(default))


def gpu_memory(crops: Column, base: int = MEMORY_BASE_MB, most: int = MEMORY_LIMIT_MB) -> Column:
    """Struct (mb, from_table, over): megabytes for so many crops, by the next larger entry of the table, else by the formula."""
    found = F.lit(None).cast("long")
    for n, mb in reversed(MEMORY_MB):
        found = F.when(crops <= n, F.lit(mb).cast("long")).otherwise(found)
    mb = F.coalesce(found, F.ceil(base + crops * 512 * 512 * 4 / 1_048_576))
    return F.struct(mb.alias("mb"), found.isNotNull().alias("from_table"), (mb > most).alias("over"))


def training_minutes(images: Column, epochs: Column, batch: int = 16) -> Column:
    """Half a second for each batch of each epoch."""
    return F.ceil(F.ceil(images / batch) * 0.5 * epochs / 60)


def spelt_minutes(minutes: Column) -> Column:
    long = F.format_string("~%dh %dm", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))
    return F.when(minutes < 60, F.format_string("~%d minutes", minutes.cast("int"))).otherwise(long)


def change_mix(json: Column) -> Column:
    """Numbers of a JSON object by lower-case key; texts that are numbers count, other values don't. Of keys that differ in case alone the last counts."""
    held = F.map_entries(F.from_json(json, "map<string, string>"))
    number = F.filter(F.transform(held, lambda e: F.struct(F.lower(e.key).alias("k"), e.value.try_cast("double").alias("v"))), lambda e: (F.abs(e.v) < float("inf")))
    last = F.filter(number, lambda e, i: ~F.exists(F.slice(number, i + 2, F.size(number)), lambda o: o.k == e.k))
    return F.map_from_entries(last)


def centre_of_json(json: Column) -> Column:
    """Struct (lat, lon) of a label's JSON: centerLat and centerLon, else the first place of its geometry's ring; null without a valid one."""
    parsed = F.from_json(json, "centerLat double, centerLon double, geometry struct<coordinates: array<array<array<double>>>>")
    at = lambda lat, lon: F.when(valid_coordinate(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))

    def of(o: Column) -> Column:
        first = F.get(F.get(o["geometry"]["coordinates"], F.lit(0)), F.lit(0))
        return F.coalesce(at(o["centerLat"], o["centerLon"]), at(F.get(first, F.lit(1)), F.get(first, F.lit(0))))

    # As an array's one value the text is parsed once, not for each condition.
    return F.get(F.transform(F.array(parsed), of), F.lit(0))


@dataclass(frozen=True)
class PlanSettings:
    """What a plan can be asked for; `held` gives the values held to their bounds."""

    min_confidence: float = 0.45
    zone_radius_m: float = 22.0
    least_detections: float = 2
    zones_per_mission: float = 16
    area_ha: float = 3.5
    litres: float = 28.0
    cruise_mps: float = 8.0
    spray_ha_per_min: float = 0.28
    dose_per_ha: float = 1.8
    lookahead_hours: float = 30
    wind: float = 8.0
    gust: float = 11.0
    precip: float = 35.0
    low_temp: float = 5.0
    high_temp: float = 35.0
    turnaround_min: float = 8.0
    start_lat: float | None = None
    start_lon: float | None = None

    def held(self) -> PlanSettings:
        """Each value within its bounds (a missing one takes its default, counts are whole), the temperatures a degree apart at least."""
        given = {f.name: f.default if getattr(self, f.name) is None else getattr(self, f.name) for f in fields(self)}
        out = {k: v if v is None or k not in BOUNDS else max(BOUNDS[k][0], min(BOUNDS[k][1], v // 1 if k in WHOLE else v)) for k, v in given.items()}
        out["low_temp"] = min(out["low_temp"], out["high_temp"] - 1)
        out["high_temp"] = max(out["high_temp"], out["low_temp"] + 1)
        return PlanSettings(**out)


#: The bounds of each setting, and those that are whole.
BOUNDS = {
    "min_confidence": (0, 1), "zone_radius_m": (8, 250), "least_detections": (1, float("inf")), "zones_per_mission": (1, float("inf")), "area_ha": (0.2, 100), "litres": (1, 1000), "cruise_mps": (1, 35), "spray_ha_per_min": (0.01, 10),
    "dose_per_ha": (0.01, 50), "lookahead_hours": (6, 72), "wind": (2, 25), "gust": (3, 35), "precip": (0, 100), "low_temp": (-10, 35), "high_temp": (5, 50), "turnaround_min": (0, 120), "start_lat": (-90, 90), "start_lon": (-180, 180),
}
WHOLE = ("least_detections", "zones_per_mission", "lookahead_hours")


#: The keys of a plan's JSON.
PLAN_KEYS = {
    "min_confidence": "minConfidence", "zone_radius_m": "zoneRadiusMeters", "least_detections": "minDetectionsPerZone", "zones_per_mission": "maxZonesPerMission", "area_ha": "maxAreaHaPerMission", "litres": "maxTankLiters", "cruise_mps": "droneCruiseSpeedMps",
    "spray_ha_per_min": "sprayRateHaPerMin", "dose_per_ha": "defaultDosePerHa", "lookahead_hours": "weatherLookaheadHours", "wind": "maxWindSpeedMps", "gust": "maxGustSpeedMps", "precip": "maxPrecipProbability", "low_temp": "minTemperatureC",
    "high_temp": "maxTemperatureC", "turnaround_min": "missionTurnaroundMinutes", "start_lat": "startLat", "start_lon": "startLon",
}
PLAN_FLAGS = {"ai": ("includeAIDetections", True), "manual": ("includeManualAnnotations", True), "unverified": ("includeUnverified", False), "return_to_start": ("returnToStart", True), "compliance": ("includeCompliance", True), "weather": ("enableWeatherOptimization", True)}


def plan_settings(json: Column) -> Column:
    """Struct of a plan's settings from a JSON object's text, as PlanSettings.held gives them, with its flags, its classes (trimmed, without blank ones) and the launch that it prefers (null where it's no time).

    Anything of another type than its setting's counts as missing, and so does text that is no object.
    """
    kinds = {k: "double" for k in PLAN_KEYS.values()} | {k: "boolean" for k, _ in PLAN_FLAGS.values()} | {"classes": "array<string>", "preferredLaunchTimeUtc": "string"}
    read = F.from_json(json, ", ".join(f"`{k}` {kind}" for k, kind in kinds.items()))
    default = PlanSettings()

    def held(name: str) -> Column:
        given = F.coalesce(F.when(F.abs(read[PLAN_KEYS[name]]) < float("inf"), read[PLAN_KEYS[name]]), F.lit(getattr(default, name)).cast("double"))
        low, high = BOUNDS[name]
        whole = F.floor(given).cast("double") if name in WHOLE else given
        return F.when(given.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), whole)))

    values = {name: held(name) for name in PLAN_KEYS}
    values["low_temp"] = F.least(values["low_temp"], values["high_temp"] - 1)
    values["high_temp"] = F.greatest(values["high_temp"], values["low_temp"] + 1)
    classes = F.filter(F.transform(F.coalesce(read["classes"], F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "")
    flags = [F.coalesce(read[k], F.lit(said)).alias(name) for name, (k, said) in PLAN_FLAGS.items()]
    return F.struct(*[v.alias(name) for name, v in values.items()], *flags, classes.alias("classes"), F.try_to_timestamp(F.trim(read["preferredLaunchTimeUtc"])).alias("preferred_launch"))


def source_flags(json: Column, names: tuple[str, ...] = ("includeAIDetections", "includeManualAnnotations", "includeSAM3")) -> Column:
    """Struct of booleans by name from a JSON object's text: which sources a training set takes. Anything but a JSON boolean counts as true."""
    read = F.from_json(json, ", ".join(f"`{n}` boolean" for n in names))
    return F.struct(*(F.coalesce(read[n], F.lit(True)).alias(n) for n in names))


def one_image_alone(ids: Column) -> Column:
    """Whether an array names exactly one image, which is all that the old kind of run may take."""
    return F.coalesce(F.size(ids) == 1, F.lit(False))


def any_contains(texts: list[Column], parts: list[str]) -> Column:
    """Whether any of the texts holds any of the parts, as written; null texts hold none."""
    hit = F.lit(False)
    for t in texts:
        for p in parts:
            hit = hit | F.coalesce(F.contains(t, F.lit(p)), F.lit(False))
    return hit


def readiness(configured: Column, gpu: Column, ready: Column, loaded: Column, concept: Column, queue: Column, training: Column, fallback: Column, models: Column) -> Column:
    """Struct of what services allow: matcher (configured, with a GPU, and its model loaded or its concept service ready), labelling (matcher and queue), training, and fallback (configured, with a model). Nulls count as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    matcher = yes(configured) & yes(gpu) & ((yes(ready) & yes(loaded)) | yes(concept))
    return F.struct(matcher.alias("matcher"), (matcher & yes(queue)).alias("labelling"), yes(training).alias("training"), (yes(fallback) & (F.coalesce(models, F.lit(0)) > 0)).alias("fallback"))


def fitted_size(width: Column, height: Column, most: int = 2048) -> Column:
    """Struct (width, height, scale) of an image whose longer side is at most so many pixels; smaller ones stay, with a scale of 1. Sides are rounded down."""
    longer = F.greatest(width, height)
    scale = F.when(longer > most, most / longer).otherwise(1.0)
    side = lambda x: F.when(longer > most, F.floor(x * (most / longer)).cast("int")).otherwise(x.cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"), scale.alias("scale"))


def _json_number(read: Column, *names: str) -> Column:
    """The first name that is there: its finite number, given as a number or as text; null for other values."""
    first = F.coalesce(*(read[n] for n in names))
    x = F.trim(first).try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


#: Names of a training run's augmentation, the later ones as other tools write them.
AUGMENTATION = {"flip": ("horizontalFlip", "horizontal_flip"), "flop": ("verticalFlip", "vertical_flip"), "turn": ("rotation", "rotation_degrees", "degrees"), "bright": ("brightness", "brightness_pct"), "rich": ("saturation", "saturation_pct"), "copies": ("copiesPerImage", "copies_per_image")}


def augmentation(preset: Column, json: Column) -> Column:
    """A training run's augmentation, from a preset's name and a JSON object's text: a struct whose fields are null where nothing is said.

    Flips become probabilities of a half (fliplr, flipud), degrees are 0 to 180 and only said when positive, brightness and saturation are 0 to 100 per cent
    (hsv_v and hsv_s from 0 to 1 say them too), copies are whole and 1 to 10. The preset none, and blank ones, are none.
    """
    names = {n for group in AUGMENTATION.values() for n in group} | {"hsv_v", "hsv_s", "blur", "shadow"}
    read = F.from_json(json, "map<string, string>")
    get = {n: F.element_at(read, n) for n in names}
    fit = lambda x, low, high: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))

    typed = F.from_json(json, ", ".join(f"`{n}` boolean" for n in (*AUGMENTATION["flip"], *AUGMENTATION["flop"], "blur", "shadow")))

    def flag(first: str, *others: str) -> Column:
        """The first name that is there, if it is a JSON boolean; texts are none."""
        return F.when(get[first].isNotNull(), typed[first]).otherwise(flag(*others)) if others else typed[first]

    def number(*keys: str) -> Column:
        return _json_number(get, *keys)

    def share(said: tuple[str, ...], hsv: str) -> Column:
        own = number(*said)
        return F.when(own.isNotNull(), fit(own, 0, 100)).otherwise(fit(number(hsv) * 100, 0, 100))

    half = lambda c: F.when(c, 0.5).when(~c, 0.0)
    flip, flop, turn = flag(*AUGMENTATION["flip"]), flag(*AUGMENTATION["flop"]), number(*AUGMENTATION["turn"])
    bright, rich = share(AUGMENTATION["bright"], "hsv_v"), share(AUGMENTATION["rich"], "hsv_s")
    copies = fit(F.floor(number(*AUGMENTATION["copies"]) + 0.5), 1, 10)
    held = lambda source, value: F.when(source.isNotNull(), value)
    return F.struct(
        F.when((F.trim(preset) != "") & (preset != "none"), preset).alias("preset"), flip.alias("horizontal_flip"), half(flip).alias("fliplr"), flop.alias("vertical_flip"), half(flop).alias("flipud"), F.when(turn > 0, fit(turn, 0, 180)).alias("degrees"),
        held(F.coalesce(number(*AUGMENTATION["bright"]), number("hsv_v")), bright).alias("brightness_pct"), held(F.coalesce(number(*AUGMENTATION["rich"]), number("hsv_s")), rich).alias("saturation_pct"),
        flag("blur").alias("blur"), flag("shadow").alias("shadow"), held(number(*AUGMENTATION["copies"]), copies).cast("int").alias("copies_per_image"),
    )
