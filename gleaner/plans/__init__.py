"""Query definitions: options, presets, jobs, whole pipelines."""
