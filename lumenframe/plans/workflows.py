"""

A runner is a name under which a function from tables to a table is known, with the parameters that it may be given and the resources
that it asks for. Jobs are plain values: building one starts nothing; ``run`` applies its steps lazily.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lumenframe.functions.hashing import decode_request, derivation_hash, enriched

LABEL = "lumenframe"


@dataclass(frozen=True)
class Runner:
    """What a runner asks for, and the parameters that it may be given."""

    resource_class: str
    memory_mb: int
    cpu_slots: int
    gpus: int
    max_concurrent: int
    group: str
    cooldown_s: int
    timeout_s: int
    params: str

    @property
    def allowed(self) -> tuple[str, ...]:
        return tuple(self.params.split())

    def profile(self):
        """The runner's needs as a Spark resource profile."""
        from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

        wants = ExecutorResourceRequests().memory(f"{self.memory_mb}m").cores(self.cpu_slots)
        return ResourceProfileBuilder().require(wants).require(TaskResourceRequests().cpus(self.cpu_slots)).build


#: The runners with class, memory, slots, optional GPUs, most at once, group, pause after running out of memory, time limit, parameters.
RUNNERS = {
    "pyradiomics_extract": Runner("cpu_heavy", 6144, 2, 0, 1, "pyradiomics_cpu", 120, 3600, "settings_file mask_asset image_asset dataset_id label_channel force2D voxel_based profile_name bin_width feature_classes name normalize resampled_spacing image_types selected_features image mask sample_id generation_id"),
    "totalsegmentator_infer": Runner("gpu_optional", 8192, 4, 1, 1, "segmentation_heavy", 0, 7200, "task fast roi_subset statistics image_asset provider image sample_id generation_id"),
    "lungmask_infer": Runner("cpu_heavy", 8192, 6, 1, 1, "torch_cpu_heavy", 1800, 3600, "model_name image_asset provider image sample_id generation_id"),
    "ct_lung_threshold": Runner("cpu", 1024, 1, 0, 4, "ct_simple", 0, 900, "threshold max_components min_voxels image_asset provider image sample_id generation_id"),
    "nnunetv2_predict": Runner("gpu_optional", 8192, 4, 1, 1, "segmentation_heavy", 0, 7200, "model_name fold checkpoint step_size image_asset provider image sample_id generation_id"),
    "monai_bundle_infer": Runner("gpu_optional", 8192, 4, 1, 1, "segmentation_heavy", 0, 7200, "bundle_name bundle_path device image_asset provider image sample_id generation_id"),
    "dicom_convert": Runner("cpu", 2048, 1, 0, 2, "imaging_io", 0, 3600, "dataset_id dicom_asset dicom_root image_asset converter"),
    "image_preprocess": Runner("cpu", 4096, 2, 0, 2, "imaging_cpu", 0, 3600, "dataset_id image_asset image_root operations spacing resampled_spacing lower upper"),
    "mask_ops": Runner("cpu", 2048, 1, 0, 4, "mask_ops", 0, 1800, "dataset_id mask_asset mask mask_b_asset mask_b reference_asset reference_image operation threshold threshold_b label labels mode radius min_voxels max_components"),
    "imaging_qc_metrics": Runner("cpu", 2048, 1, 0, 4, "imaging_qc", 0, 1800, "dataset_id image_asset image_root mask_asset mask_root"),
    "rt_convert": Runner("cpu", 4096, 2, 0, 2, "imaging_rt", 0, 3600, "dataset_id rt_asset rt_struct_asset rt_root rt_file dicom_asset dicom_root reference_asset reference_image image_asset rois"),
    "rt_dose_plan": Runner("cpu", 4096, 2, 0, 2, "imaging_rt", 0, 3600, "dataset_id dose_asset dose_file dose_root plan_asset plan_file plan_root mask_asset mask_root"),
    "imaging_qc_visuals": Runner("cpu", 2048, 1, 0, 4, "imaging_qc", 0, 1800, "dataset_id image_asset image_root mask_asset mask_root max_size max_images anonymize_names"),
    "image_spatial": Runner("cpu_heavy", 6144, 4, 0, 2, "imaging_cpu", 0, 7200, "dataset_id image_asset image_root mask_asset mask_root reference_asset reference_image operations spacing crop_size"),
    "wsi_tile": Runner("cpu_heavy", 4096, 2, 0, 2, "pathology_io", 0, 7200, "dataset_id wsi_asset wsi_root tile_size stride max_tiles tissue_threshold write_tiles"),
    "image_embeddings": Runner("gpu_optional", 4096, 2, 1, 2, "image_embeddings", 0, 3600, "dataset_id image_asset image_root model bins"),
}
#: Which runner serves a segmentation provider.
SEGMENTERS = {
    "totalsegmentator": "totalsegmentator_infer", "totalsegmentator_infer": "totalsegmentator_infer", "lungmask": "lungmask_infer", "lungmask_infer": "lungmask_infer",
    "ct_lung_threshold": "ct_lung_threshold", "nnunetv2_predict": "nnunetv2_predict", "monai_bundle_infer": "monai_bundle_infer",
}
#: The feature classes and image types of the bundled extraction profiles, and their settings.
_COMMON = {"binWidth": 25, "label": 1, "geometryTolerance": 1e-6}
PROFILES = {
    "aerts_signature_v1": {"setting": {**_COMMON, "resampledPixelSpacing": None, "interpolator": "sitkBSpline", "normalize": False, "force2D": False, "preCrop": True, "padDistance": 5, "additionalInfo": True}, "featureClass": {"firstorder": ["Energy"], "shape": ["Compactness1"], "glrlm": ["RunLengthNonUniformity"]}, "imageType": {"Original": {}, "Wavelet": {"wavelet": "coif1", "start_level": 0, "level": 1}}},
    "demo_ct_firstorder_v1": {"setting": {**_COMMON, "resampledPixelSpacing": None, "interpolator": "sitkBSpline", "normalize": False, "force2D": False, "additionalInfo": False}, "featureClass": {"firstorder": None}, "imageType": {"Original": {}}},
    "ibsi_ct_3d_v1": {"setting": {**_COMMON, "resampledPixelSpacing": [1, 1, 1], "interpolator": "sitkBSpline", "normalizeScale": 1, "normalize": True, "force2D": False, "force2Ddimension": 0, "additionalInfo": True}, "featureClass": dict.fromkeys(("firstorder", "glcm", "glrlm", "glszm", "gldm", "ngtdm")), "imageType": {"Original": {}, "LoG": {"sigma": [1.0, 2.0, 3.0]}, "Wavelet": {}}},
    "ibsi_force2d_v1": {"setting": {**_COMMON, "force2D": True, "force2Ddimension": 0, "normalize": True, "normalizeScale": 1, "additionalInfo": True}, "featureClass": dict.fromkeys(("firstorder", "glcm", "glrlm")), "imageType": {"Original": {}}},
    "ibsi_mr_3d_v1": {"setting": {**_COMMON, "resampledPixelSpacing": [1, 1, 1], "interpolator": "sitkBSpline", "normalizeScale": 1, "normalize": True, "force2D": False, "additionalInfo": True}, "featureClass": dict.fromkeys(("firstorder", "glcm", "glrlm", "glszm", "gldm")), "imageType": {"Original": {}, "LoG": {"sigma": [2.0, 3.0]}}},
    "voxel_map_firstorder_v1": {"setting": {**_COMMON, "normalize": True, "normalizeScale": 1, "force2D": False, "voxelBased": True, "kernelRadius": 2}, "featureClass": {"firstorder": None}, "imageType": {"Original": {}}},
}

_IMPLEMENTATIONS: dict[str, Callable[..., DataFrame]] = {}
_HOOKS: dict[str, list[Callable]] = {}


# -- runners (UDF-01, UDF-03)


def implement(name: str):
    """Registers a function ``(inputs: dict of tables, config: dict) -> table`` as what a runner does."""
    if name not in RUNNERS:
        raise ValueError(f"unknown runner: {name}")

    def keep(fn):
        _IMPLEMENTATIONS[name] = fn
        return fn

    return keep


def checked(name: str, config: dict) -> dict:
    """The configuration, if the runner may be given all of it."""
    if name not in RUNNERS:
        raise ValueError(f"unknown runner: {name}")
    odd = sorted(set(config) - set(RUNNERS[name].allowed))
    if odd:
        raise ValueError(f"{name} takes no {', '.join(odd)}")
    return config


def run_step(name: str, inputs: dict[str, DataFrame], config: dict) -> DataFrame:
    """What a runner makes of its inputs, lazily."""
    config = checked(name, config)
    if name not in _IMPLEMENTATIONS:
        raise NotImplementedError(f"nothing is registered for {name}")
    return _IMPLEMENTATIONS[name](inputs, config)


def health() -> list[dict]:
    """UDF-01: each runner with whether something is registered for it."""
    return [{"runner": n, "ready": n in _IMPLEMENTATIONS, "resource_class": r.resource_class} for n, r in sorted(RUNNERS.items())]


def segmenter_runner(provider: str) -> str:
    """CND-02."""
    if provider not in SEGMENTERS:
        raise ValueError(f"Unknown segmentation provider: {provider}")
    return SEGMENTERS[provider]


# -- publisher hooks (UDF-02)


def on_publish(kind: str):
    """Registers a callback ``(context: dict) -> dict`` for a kind of publication."""

    def keep(fn):
        _HOOKS.setdefault(kind, []).append(fn)
        return fn

    return keep


def publish(kind: str, context: dict) -> list[dict]:
    """Calls a kind's callbacks in their order, on the driver, after the data are written."""
    if kind not in _HOOKS:
        raise ValueError(f"nothing publishes {kind}")
    return [fn(context) for fn in _HOOKS[kind]]


# -- models (UDF-04) and profiles (UDF-05)


def models_listed(manifests: dict[str, dict | None]) -> list[dict]:
    """UDF-04: the models of a registry by file name; a manifest that could not be read (None) is left out."""
    return [{"name": m.get("name") or f, "provider": m.get("provider") or "unknown", "task": m.get("task") or "segmentation", "path": m.get("path") or os.path.dirname(f)} for f, m in sorted(manifests.items()) if m is not None]


def predicted(images: DataFrame, load: Callable[[], Callable], schema: str) -> DataFrame:
    """VOX-13: ``load()`` gives a function from a pandas frame of ``images`` to one of ``schema``; it is loaded once a task.

    Rows are what the model takes at a time (an image, a tile), so a task holds one Arrow batch of them.
    """

    def run(frames):
        model = load()
        for f in frames:
            yield model(f)

    return images.mapInPandas(run, schema)


def profile_names(own: dict[str, dict] | None = None) -> list[str]:
    """UDF-05, SET-05: bundled profiles and then those of the site that are new."""
    return list(dict.fromkeys([*sorted(PROFILES), *sorted(own or {})]))


def profile(name: str, own: dict[str, dict] | None = None) -> dict:
    """UDF-05, STR-13: a profile by name; the site's goes before the bundled one. A name of other than letters, digits and _ is unknown."""
    found = ((own or {}).get(name) or PROFILES.get(name)) if re.fullmatch(r"[a-zA-Z0-9_]+", name) else None
    if found is None:
        raise ValueError(f"Profile not found: {name}")
    return found


# -- environment (CND-03, STR-10)


def env_name(value: str) -> str:
    """STR-10: a name as an environment variable."""
    return re.sub(r"[^A-Za-z0-9]+", "_", value).upper()


class Config:
    """CND-03: settings as strings, read as what is wanted; what is empty or no number is the default."""

    def __init__(self, values: dict[str, str], prefix: str = ""):
        self.values, self.prefix = values, prefix

    def text(self, name: str, default=None):
        return self.values.get(self.prefix + name.upper()) or default

    def flag(self, name: str, default: bool = False) -> bool:
        value = str(self.text(name, "")).strip().lower()
        return value in ("1", "true", "yes", "y") if value else bool(default)

    def number(self, name: str, default: float = 0.0) -> float:
        try:
            return float(self.text(name, default))
        except (TypeError, ValueError):
            return float(default)

    def whole(self, name: str, default: int = 0) -> int:
        try:
            return int(float(self.text(name, default)))
        except (TypeError, ValueError, OverflowError):
            return int(default)

    def items(self, name: str, default: list[str] | None = None) -> list[str]:
        """STR-08: a comma-joined list without empty items."""
        value = self.text(name)
        return list(default or []) if value is None else [x.strip() for x in str(value).split(",") if x.strip()]


# -- jobs (UDF-07)


def _required(request: dict, name: str):
    value = request.get(name)
    if not isinstance(value, str) or not value:
        raise ValueError(f"{name} is required.")
    return value


def _step(kind: str, plane: str = "session", **more) -> dict:
    return {"type": kind, "plane": plane, **more}


def _job(request: dict, name: str, tags: list[str], steps: list[dict]) -> dict:
    job = {"steps": steps, "name": request.get("name") or name, "label": LABEL, "tags": tags, "visibility": request.get("visibility") or "private", "resource_class": "default"}
    return {**job, "job_id": request["job_id"]} if request.get("job_id") is not None else job


def _chain(dataset_id: str, *work: tuple[str, dict], asset: str, kind: str, publisher: str, **published) -> list[dict]:
    runs = [_step("run_artifact", "artifact", runner=r, config=checked(r, c)) for r, c in work]
    last = _step("publish_asset", dataset_id=dataset_id, asset_name=asset, asset_type=kind, publish_kind=publisher, **published)
    return [_step("resolve_dataset", dataset_id=dataset_id), *runs, last, _step("safe_summary")]


def reuse(asset_id: str, dataset_id: str) -> dict:
    return {"action": "reused", "deduplicated": True, "asset_id": asset_id, "dataset_id": dataset_id}


def _only(runner: str, config: dict) -> dict:
    return {k: v for k, v in config.items() if k in RUNNERS[runner].allowed and v is not None}


def radiomics_job(request: dict, known: Callable[[str, str], str | None] = lambda dataset, digest: None) -> dict:
    """UDF-07: extraction of features from an image and a mask asset, or the asset that has them already."""
    dataset, image, mask = _required(request, "dataset_id"), request.get("image_asset") or "images", _required(request, "mask_asset")
    p = request.get("profile") or {"name": "ibsi_ct_3d_v1", "bin_width": 25}
    digest = derivation_hash(dataset_id=dataset, image_asset=image, mask_asset=mask, profile_name=p.get("name"), bin_width=p.get("bin_width"), force2D=p.get("force2D", False), feature_classes=p.get("feature_classes"))
    if (found := known(dataset, digest)) is not None:
        return reuse(found, dataset)
    config = {**p, "mask_asset": mask, "image_asset": image, "settings_file": p.get("name")}
    steps = _chain(dataset, ("pyradiomics_extract", _only("pyradiomics_extract", config)), asset="radiomics", kind="feature_table", publisher="imaging_radiomics_asset", alias=request.get("alias"), runner="pyradiomics_extract", config=config, derivation_hash=digest)
    return _job(request, f"{dataset} radiomics extraction", ["extraction", dataset, p.get("name")], steps)


def segmentation_job(request: dict, known: Callable[[str, str], str | None] = lambda dataset, digest: None) -> dict:
    """UDF-07: masks for an image asset; an existing mask asset is used as it is."""
    dataset, seg = _required(request, "dataset_id"), request.get("segmenter")
    if not seg:
        raise ValueError("segmenter is required.")
    if seg.get("provider") == "existing_mask_asset":
        return reuse(seg.get("mask_asset"), dataset)
    image = request.get("image_asset") or "images"
    digest = derivation_hash(dataset_id=dataset, image_asset=image, provider=seg["provider"], task=seg.get("task") or "default", model_name=seg.get("model_name") or seg.get("bundle_name") or "default")
    if (found := known(dataset, digest)) is not None:
        return reuse(found, dataset)
    runner = segmenter_runner(seg["provider"])
    config = {**seg, "image_asset": image}
    steps = _chain(dataset, (runner, _only(runner, config)), asset="masks", kind="mask_root", publisher="imaging_asset", alias=request.get("alias"), runner=runner, config=config, derivation_hash=digest)
    return _job(request, f"{dataset} segmentation", ["segmentation", dataset, seg["provider"]], steps)


def segment_and_extract_job(request: dict) -> dict:
    """UDF-07: masks and then features, in one job."""
    dataset, seg = _required(request, "dataset_id"), request.get("segmenter")
    if not seg:
        raise ValueError("segmenter is required.")
    p, image = request.get("profile") or {"name": "ibsi_ct_3d_v1", "bin_width": 25}, request.get("image_asset") or "images"
    extract = _only("pyradiomics_extract", {**p, "image_asset": image, "settings_file": p.get("name")})
    work = [("pyradiomics_extract", {**extract, "mask_asset": seg.get("mask_asset")})]
    if seg.get("provider") != "existing_mask_asset":
        runner = segmenter_runner(seg["provider"])
        work = [(runner, _only(runner, {**seg, "image_asset": image})), ("pyradiomics_extract", extract)]
    digest = derivation_hash(dataset_id=dataset, image_asset=image, segmenter=seg, profile=p)
    steps = _chain(dataset, *work, asset="radiomics", kind="feature_table", publisher="imaging_radiomics_asset", alias=request.get("alias"), derivation_hash=digest)
    return _job(request, f"{dataset} segmentation and extraction", ["segment_extract", dataset, seg.get("provider")], steps)


def asset_job(request: dict, runner: str, asset: str, kind: str, known: Callable[[str, str], str | None] = lambda dataset, digest: None) -> dict:
    """UDF-07: one runner over a data set (quality, conversion, preprocessing, dose, tiles, embeddings ...), published as an asset."""
    dataset = _required(request, "dataset_id")
    config = checked(runner, {k: v for k, v in (request.get("config") or {}).items() if v is not None})
    digest = derivation_hash(dataset_id=dataset, runner=runner, config=config)
    if (found := known(dataset, digest)) is not None:
        return reuse(found, dataset)
    steps = _chain(dataset, (runner, config), asset=asset, kind=kind, publisher="imaging_asset", alias=request.get("alias"), runner=runner, config=config, derivation_hash=digest)
    return _job(request, f"{dataset} {runner}", [runner, dataset], steps)


def requested(encoded) -> dict:
    """JSN-02: a request as it comes in: encoded, JSON, or a value already."""
    value = decode_request(encoded) if isinstance(encoded, str) else encoded
    if not isinstance(value, dict):
        raise ValueError("a request is an object")
    return value


def with_hashes(job: dict, hashes: DataFrame) -> dict:
    """JN-20: a job as it is submitted; it needs a label."""
    if not isinstance(job.get("label"), str) or not job["label"]:
        raise ValueError("a job needs a label")
    return enriched(job, hashes)


def run(job: dict, inputs: dict[str, DataFrame]) -> DataFrame | None:
    """The table that a job's runners make, one after the other; each also sees its predecessor's as ``previous``. Nothing is computed yet."""
    out = None
    for step in job.get("steps", []):
        if step["type"] == "run_artifact":
            out = run_step(step["runner"], inputs if out is None else {**inputs, "previous": out}, step["config"])
    return out
