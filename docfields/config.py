"""Settings: JSON with defaults, read once on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any


class ServiceError(Exception):
    """Carries one of the codes of ``schema.ERRORS``."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Quality:
    minimum_width: int = 800
    minimum_height: int = 800
    blur_threshold: float = 80.0
    overexposure_fraction: float = 0.15
    underexposure_fraction: float = 0.20
    empty_image_threshold: float = 0.01


@dataclass(frozen=True)
class Preprocess:
    enable_document_detection: bool = True
    enable_perspective_correction: bool = True
    target_width: int = 2480
    target_height: int = 3508
    canny_low: float = 50.0
    canny_high: float = 150.0
    min_contour_area_fraction: float = 0.05
    enable_grayscale: bool = False
    enable_contrast_enhancement: bool = True
    clahe_clip_limit: float = 2.0
    clahe_tile_size: int = 8
    enable_adaptive_threshold: bool = False
    adaptive_threshold_block: int = 11
    adaptive_threshold_c: float = 2.0
    enable_denoise: bool = True
    gaussian_kernel: int = 3
    gaussian_sigma: float = 1.0
    enable_orientation_correction: bool = True


@dataclass(frozen=True)
class Engine:
    engine: str = "mock"
    model_directory: str = ""
    use_gpu: bool = False
    cpu_threads: int = 4
    minimum_confidence: float = 0.65
    mock_data_path: str = ""


@dataclass(frozen=True)
class Config:
    engine: Engine = field(default_factory=Engine)
    preprocess: Preprocess = field(default_factory=Preprocess)
    quality: Quality = field(default_factory=Quality)
    mask_id_number: bool = True
    templates_directory: str = ""


def _known(kind: type, values: dict[str, Any]) -> Any:
    return kind(**{f.name: values[f.name] for f in fields(kind) if f.name in values})


def parse(text: str) -> Config:
    """Config from JSON text; every known key of a section is read, others are ignored.  Bad JSON is error 1003."""
    try:
        tree = json.loads(text)
        if not isinstance(tree, dict):
            raise ValueError("not an object")
        steps = tree.get("preprocessing", {})
        return Config(
            _known(Engine, tree.get("ocr", {})),
            _known(Preprocess, steps),
            _known(Quality, steps),
            bool(tree.get("privacy", {}).get("mask_id_number", True)),
            tree.get("templates_directory", "./config/templates"),
        )
    except (ValueError, TypeError, AttributeError) as bad:
        raise ServiceError(1003, f"Configuration cannot be read: {bad}") from bad


def load(path: str | None) -> Config:
    """Config of a file, or the defaults (with no templates) where no file is named.  A missing file is error 1003."""
    if not path:
        return Config()
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except OSError as missing:
        raise ServiceError(1003, f"Configuration file not found: {path}") from missing
