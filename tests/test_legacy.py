from __future__ import annotations

import plistlib

import pytest

from foliospark.plans import legacy
from foliospark.plans.options import OptionError, resolve


@pytest.mark.parametrize("binary", [False, True])
def test_settings_become_options(tmp_path, binary):
    f = tmp_path / "x.pdfscp"
    one = {"title": "small", "optimizeImages": 1, "imageQuality": 0.57, "imageResolution": 150.0, "downsampleMonochromeScans": True, "stripMetadata": True, "removeTitle": True, "customTitle": "T", "updateModificationDate": True, "reduceColorComplexity": False}
    f.write_bytes(plistlib.dumps([one, {"title": "other", "optimizeImages": False, "clipImages": True, "imageQuality": 0.5}], fmt=plistlib.FMT_BINARY if binary else plistlib.FMT_XML))
    got = legacy.load(f, "small")
    assert got == {"images": True, "image_quality": 57, "dpi": 150, "mono_dpi": 150, "strip": ("metadata",), "metadata": (("Title", "T"),), "timestamps": "modified", "color_reduction": "preserve"}
    assert resolve({"dpi": 72}, got).dpi == 72
    assert legacy.load(f, "2") == {"images": False, "clip_images": False, "force_recompression": False, "timestamps": "preserve"}
    with pytest.raises(OptionError):
        legacy.load(f)


def test_quality_is_cut_to_whole_steps():
    assert [legacy.profile({"imageQuality": q})[1]["image_quality"] for q in (0.57, 0.5799, 0.0, 1.0, 0.29)] == [57, 57, 1, 100, 29]


@pytest.mark.parametrize("settings", [{"other": True}, {"title": 1}, {"clipImages": 2}, {"imageQuality": 1.5}, {"imageResolution": 0.5}, {"colorConversion": 1}, {"optimizeResources": False}, {"removeProducer": True}, {"imageQuality": True}])
def test_settings_without_an_equal(settings):
    with pytest.raises(OptionError):
        legacy.profile(settings)


def test_damaged_lists(tmp_path):
    f = tmp_path / "x"
    for raw in (b"", b"x", plistlib.dumps([]), plistlib.dumps({"a": 1})):
        f.write_bytes(raw)
        with pytest.raises(OptionError):
            legacy.load(f)
