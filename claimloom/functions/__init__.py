"""Column builders: canonical values, hashes, confidences."""
