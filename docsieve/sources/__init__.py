"""Sources and sinks: file manifests, ground truth, OCR side files, reports."""
