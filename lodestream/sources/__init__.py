"""Tables with contracts, member scans of TAR shards, manifests, mirrors and the writers that go with them."""
