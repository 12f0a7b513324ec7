"""Fixed values of the quality definitions: names, thresholds, presets, penalties, formats."""

from __future__ import annotations

#: The feature vector's names in order; the first 15 are due in every row.
FEATURES = [
    "megapixels", "width", "height", "aspectRatio", "fileSize", "bpp", "brightnessAvg", "brightnessStdevMax",
    "laplacianStdev", "laplacianMean", "laplacianVariance", "edgeRatio", "dpi", "isJpeg", "presetIdx",
    "foregroundRatio", "sharpnessRatioTopBot", "brightnessDiffTopBot", "shadowEdgeCenterDiff", "centerBrightness", "edgeBrightness",
    "backgroundP90", "skewAngle", "colorSaturation", "fftHighFreqRatio", "fftSpectralPeaks", "fftJpegBlockiness",
    "zoneBrightnessDiff", "zoneSharpnessRatio", "directionalEnergyRatio", "zoneBrightness0", "zoneBrightness1", "zoneBrightness2", "zoneBrightness3",
    "zoneSharpness0", "zoneSharpness1", "zoneSharpness2", "zoneSharpness3", "channelCount", "textBaselineDeviation", "textCharSizeCV", "textCharShapeCV",
]
FAST_FEATURES = FEATURES[:15]

#: Features of the quick check on a thumbnail.
PREFLIGHT_FEATURES = ["megapixels", "fileSize", "brightnessAvg", "brightnessStdevMax", "laplacianStdev", "edgeRatio", "foregroundRatio", "blankStdevMax"]

#: Thresholds of the document preset.
THRESHOLDS = {
    "resolutionMin": 0.3, "brightnessMin": 50.0, "brightnessMax": 245.0, "sharpnessMin": 15.0, "sharpnessMax": 80.0,
    "edgeDensityMin": 0.015, "edgeDensityMax": 0.5, "contrastMin": 0.01, "contrastMax": 0.85, "fileSizeMin": 15000.0, "fileSizeMax": 1e8,
    "resolutionMax": 200.0, "uniformitySharpnessRatio": 3.5, "uniformityBrightnessDiff": 45.0, "passThreshold": 0.5, "analysisMaxPx": 1500.0,
    "dpiMin": 150.0, "blankVarianceMax": 2.0, "skewAngleMax": 10.0, "shadowBrightnessDiff": 60.0, "compressionBppMin": 0.5,
    "colorSaturationMin": 0.01, "moireCorrelationMax": 0.65, "backgroundP90Min": 170.0, "darkShadowCenterMax": 150.0, "darkShadowDiffMin": 20.0,
    "fftBlurHighFreqMin": 0.005, "fftNoiseHighFreqMax": 0.85, "fftMoirePeaksMax": 15000.0, "fftJpegGridMax": 0.5,
    "zoneBrightnessMaxDiff": 60.0, "zoneSharpnessMinRatio": 0.25, "directionalBlurRatioMax": 4.0, "ocrConfidenceMin": 60.0,
    "baselineDeviationMax": 0.02, "charSizeCVMax": 0.5, "charShapeCVMax": 0.4, "laplacianEdgeThreshold": 30.0, "binarizationThreshold": 128.0,
}

#: What the other presets change.
PRESETS = {
    "document": {},
    "receipt": {
        "resolutionMin": 0.5, "brightnessMin": 80.0, "brightnessMax": 220.0, "sharpnessMin": 20.0, "fileSizeMin": 50000.0, "passThreshold": 0.6,
        "fftBlurHighFreqMin": 0.003, "backgroundP90Min": 100.0, "darkShadowCenterMax": 100.0, "zoneBrightnessMaxDiff": 80.0, "baselineDeviationMax": 0.03,
    },
    "card": {
        "resolutionMin": 0.3, "brightnessMin": 60.0, "brightnessMax": 240.0, "sharpnessMin": 15.0, "edgeDensityMin": 0.02, "contrastMin": 0.02,
        "contrastMax": 0.80, "fileSizeMin": 30000.0, "uniformitySharpnessRatio": 3.0, "uniformityBrightnessDiff": 35.0, "passThreshold": 0.6,
        "fftJpegGridMax": 0.3, "zoneSharpnessMinRatio": 0.3,
    },
}

#: Thresholds of the quick check.
PREFLIGHT = {
    "resolutionMin": 0.28, "resolutionMax": 220.0, "fileSizeMin": 13500.0, "fileSizeMax": 1.1e8, "brightnessMin": 45.0, "brightnessMax": 247.0,
    "sharpnessMin": 5.0, "blankStdevMax": 1.7, "edgeDensityMin": 0.005, "contrastFgMin": 0.008, "laplacianEdgeThreshold": 30.0, "binarizationThreshold": 128.0,
}

#: Labels of the tier folders; unsorted files have none.
TIER_LABELS = {"very-good": 0.87, "good": 0.62, "bad": 0.37, "very-bad": 0.12}
#: Category folders and the preset each stands for.
CATEGORY_PRESETS = {"documents": "document", "receipts": "receipt", "cards": "card", "photos": "document"}
PRESET_INDEX = {"document": 0, "receipt": 1, "card": 2}

#: Supported formats.
FORMATS = ["jpeg", "png", "webp", "avif", "tiff", "gif", "svg", "heif"]
EXTENSIONS = ["jpg", "jpeg", "png", "webp", "tiff", "tif", "gif", "pdf", "heic", "avif"]

#: Advice for each issue code, in our own words.
GUIDANCE = {
    "low-resolution": "Too few pixels; move closer or use a better camera.",
    "resolution-too-high": "Too many pixels; send a smaller version.",
    "file-too-small": "The file is tiny; send the original, not a preview.",
    "file-too-large": "The file is very big; send a smaller one.",
    "too-dark": "The picture is dark; add light and try again.",
    "overexposed": "The picture is too bright; keep direct light off the page.",
    "noisy": "The picture is grainy; use light rather than zoom.",
    "blurry": "The picture is soft; hold still and let the camera focus.",
    "low-dpi": "The scan is coarse; scan at 300 dots per inch.",
    "blank-page": "The page looks empty; send one with content.",
    "heavy-compression": "Compression has cost detail; send a better copy.",
    "low-edge-density": "Hardly anything to read; check that the page is in view.",
    "high-edge-density": "The background is busy; use a plain surface.",
    "low-contrast": "Text barely stands out; improve the light.",
    "too-dark-content": "Nearly everything is dark; check the side and the light.",
    "uneven-focus": "One half is sharper; hold the camera level.",
    "uneven-lighting": "One half is brighter; light the page evenly.",
    "shadow-on-edges": "Shadows lie on the borders; move what casts them.",
    "dark-shadow": "The page is dim and shaded; find an evenly lit place.",
    "dim-background": "The paper looks grey; use more light.",
    "uneven-zone-brightness": "One corner is much darker; light the page evenly.",
    "uneven-zone-sharpness": "One corner is much softer; hold the camera level.",
    "wavy-text-lines": "Lines of text bend; flatten the page.",
    "inconsistent-char-size": "Letters differ in size; smooth out folds.",
    "distorted-char-shapes": "Letters are bent; smooth out the page.",
    "tilted": "The page is crooked; take it straight from above.",
    "grayscale-in-color": "A grey image in colour format, perhaps a copy of a copy.",
    "fft-blur": "The whole frame is soft; hold still and focus.",
    "fft-noise": "Grain over the whole frame; use more light.",
    "fft-moire": "A repeating pattern shows; don't photograph a screen.",
    "moire-pattern": "A repeating pattern shows; take it from the original.",
    "jpeg-artifacts": "Compression blocks are visible; raise the quality.",
    "directional-blur": "The camera moved; rest it on something.",
    "low-ocr-confidence": "The text can't be read with confidence; sharpen and light it.",
    "custom": "A check of your own found a fault.",
}
