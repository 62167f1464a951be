"""Feed readers, canonical schemas, the star-schema adapter, the synthetic feed generator and the bundle sink."""
