"""Settings exported by older tools as property lists, as profiles."""

from __future__ import annotations

import math
import plistlib
from pathlib import Path

from .options import METADATA, OptionError

# Keys of the settings, and what each says here.
SWITCHES = {"optimizeImages": "images", "clipImages": "clip_images", "forceRecompression": "force_recompression", "convertToCFF": "cff_fonts", "mergeEmbeddedFonts": "merge_fonts", "removeStandardFonts": "remove_standard_fonts", "subsetFonts": "subset_fonts"}
STRIPS = {"stripMetadata": "metadata", "stripPieceInfo": "piece-info", "stripThreads": "threads", "stripThumbnails": "thumbnails", "stripSpiderInfo": "web-capture", "stripAlternateImages": "alternates", "stripDocumentStructureTree": "tags", "stripTheDocumentOutputIntents": "output-intents", "removeAllImages": "images"}
FLATTENS = {"stripAndFlattenFormFields": "forms", "stripAndFlattenLinkAnnotations": "links", "stripAndFlattenAnnotationsExceptFormFieldsAndLinks": "annotations", "flattenRemainingAnnotations": "annotations"}
TEXTS = {"title", "uuid", *(f"custom{k}" for k in METADATA[:6])}
NUMBERS = {"imageQuality", "imageResolution", "colorConversion", "rank"}
OTHERS = {"createPDFA4", "reduceColorComplexity", "downsampleMonochromeScans", "optimizeResources", "removeRedundantObjects", *(f"remove{k}" for k in METADATA[:6]), "updateModificationDate", "updateModificationAndCreationDate", "hasBeenCreatedByApp"}
BOOLEANS = {*SWITCHES, *STRIPS, *FLATTENS, *OTHERS}


def _read(key: str, value: object) -> object:
    """A setting by its kind; booleans may be 0 and 1."""
    if key in TEXTS and isinstance(value, str):
        return value
    if key in NUMBERS and isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value):
        return value
    if key in BOOLEANS and (isinstance(value, bool) or isinstance(value, int) and value in (0, 1)):
        return bool(value)
    raise OptionError(f"settings: {key} is unknown or of a wrong kind")


def profile(settings: dict[str, object]) -> tuple[str, dict[str, object]]:
    """The name of the settings and the options that they stand for."""
    s = {k: _read(k, v) for k, v in settings.items()}
    if s.get("colorConversion", 0):
        raise OptionError("settings: colorConversion has no equal here")
    if s.get("optimizeResources") is False or s.get("removeRedundantObjects") is False:
        raise OptionError("settings: structural optimization is always on")
    out: dict[str, object] = {option: s[k] for k, option in SWITCHES.items() if k in s}
    if s.get("createPDFA4"):
        out["pdfa"] = "4"
    quality, dpi = s.get("imageQuality"), s.get("imageResolution")
    if quality is not None and not 0 <= quality <= 1 or dpi is not None and not (0 <= dpi <= 9600 and dpi == int(dpi)):
        raise OptionError("settings: imageQuality 0 to 1, imageResolution a whole number to 9600")
    if s.get("optimizeImages") is False:
        out |= {"clip_images": False, "force_recompression": False}
    else:
        if quality is not None:
            out["image_quality"] = max(1, int(math.nextafter(quality * 100, math.inf)))
        if dpi is not None:
            out["dpi"] = int(dpi)
            if s.get("downsampleMonochromeScans"):
                out["mono_dpi"] = int(dpi)
    if "reduceColorComplexity" in s:
        out["color_reduction"] = "exact" if s["reduceColorComplexity"] else "preserve"
    for option, table in (("strip", STRIPS), ("flatten", FLATTENS)):
        if chosen := tuple(dict.fromkeys(v for k, v in table.items() if s.get(k))):
            out[option] = chosen
    changed = [(k, s.get(f"custom{k}", "")) for k in METADATA[:6] if s.get(f"remove{k}")]
    if ("Producer", "") in changed:
        raise OptionError("settings: a removed producer needs a new one")
    if changed:
        out["metadata"] = tuple(changed)
    out["timestamps"] = "now" if s.get("updateModificationAndCreationDate") else "modified" if s.get("updateModificationDate") else "preserve"
    return str(s.get("title", "")), out


def load(path: str | Path, entry: str = "") -> dict[str, object]:
    """The options of an entry (a title, or a number from 1) of a property list of settings."""
    raw = Path(path).read_bytes()
    try:
        top = plistlib.loads(raw)
    except Exception as e:  # noqa: BLE001 - the parser raises many kinds
        raise OptionError(f"settings: {e}") from None
    if len(raw) > 1 << 20 or not isinstance(top, list) or not top or not all(isinstance(x, dict) for x in top):
        raise OptionError("settings: a list of dictionaries of at most 1 MiB")
    found = [profile(x) for x in top]
    picked = [o for i, (name, o) in enumerate(found, 1) if not entry or entry in (name, str(i))]
    if len(picked) != 1:
        raise OptionError("settings: choose an entry")
    return picked[0]
