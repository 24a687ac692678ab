"""Sources and sinks: source trees, tool reports, embedding caches, baselines, configuration."""
