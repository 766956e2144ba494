"""Canonical columns of raw tables and entities, aliases of their names, fixed values."""

from __future__ import annotations

ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"
SWAP_SELECTOR = "0x38ed1739"
#: End of the points window, its length in seconds, and points per unit and day.
WINDOW_END, WINDOW_SECONDS, POINTS_PER_DAY = 1747451507, 1215588, 1000

RAW_LOGS = "id string, address string, topics string, data string, block_number long, block_timestamp long, transaction_hash string"
RAW_BLOCKS = "id string, number long, hash string, parent_hash string, timestamp long"
RECEIPT_TRANSACTIONS = (
    "id string, hash string, from_address string, to_address string, block_number long,"
    " receipt_gas_used decimal(38,0), gas_price decimal(38,0), receipt_effective_gas_price decimal(38,0)"
)
RAW_TRACES = (
    "id string, transaction_hash string, from_address string, to_address string, trace_type string,"
    " input string, output string, block_number long, trace_address array<int>"
)

#: entity -> canonical column -> names it goes by, the first that exists and isn't null counts.
ALIASES: dict[str, dict[str, list[str]]] = {
    "transfer": {
        "id": ["id"],
        "from": ["from", "from__", "from_address", "sender", "senderAddress"],
        "to": ["to", "to__", "to_address", "recipient", "recipientAddress"],
        "value": ["value", "amount"],
        "block_number": ["block_number", "blockNumber", "number"],
        "transaction_hash": ["transaction_hash", "transactionHash", "hash"],
        "timestamp": ["timestamp", "block_timestamp", "blockTimestamp"],
    },
    "block": {
        "number": ["number", "blockNumber", "block_number"],
        "hash": ["hash", "id"],
        "parent_hash": ["parent_hash", "parentHash"],
        "timestamp": ["timestamp", "block_timestamp"],
    },
    "pair": {
        "id": ["id", "pair", "pairId"],
        "token0": ["token0"],
        "token1": ["token1"],
        "factory": ["factory"],
        "created_at": ["created_at", "createdAt", "blockNumber"],
    },
    "event": {
        "id": ["id", "event_id", "eventId"],
        "user": ["user", "user_id", "userId", "USER_ID"],
        "kind": ["kind", "event_type", "eventType", "EVENT_TYPE"],
        "value": ["value", "amount", "VALUE"],
        "timestamp": ["timestamp", "ts", "ts_ms"],
    },
}

# topic0 of each event, its parameters in order, and which are
# indexed. Spark has no Keccak hash to derive the topics from the signatures.
EVENTS: dict[str, tuple[str, list[tuple[str, str, bool]]]] = {
    "Approval": ("0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925", [("owner", "address", True), ("spender", "address", True), ("value", "uint256", False)]),
    "BasculeChanged": ("0xa0317ebf02283589c190260fcd549e3a6de71bef31204aeb5417c07fb65c0894", [("prevVal", "address", True), ("newVal", "address", True)]),
    "BatchMintSkipped": ("0x199445030f34ba18eca81d4647be9cf6943287dd1a58d150f9cf093111240bff", [("payloadHash", "bytes32", True), ("payload", "bytes", False)]),
    "BridgeChanged": ("0xd565484d693f5157abcceb853139678038bc740991b0a4dc3baa2426325bb3c0", [("prevVal", "address", True), ("newVal", "address", True)]),
    "BurnCommissionChanged": ("0x2e7c1540076270015f38f524150bcb5d6ba9db14aca34c2e6d32e6ffad37941a", [("prevValue", "uint64", True), ("newValue", "uint64", True)]),
    "ClaimerUpdated": ("0x0d4de5cd7f05b154b7f42e4f1dd68f5c27ea0edaf9bd084309201cfa52e85926", [("claimer", "address", True), ("isClaimer", "bool", False)]),
    "ConsortiumChanged": ("0x146dd8feba84cdc776f012478adc764591d6c0c9570adbc49ff09c648282a0a0", [("prevVal", "address", True), ("newVal", "address", True)]),
    "DustFeeRateChanged": ("0x78739e78c1e8bc1416322baf73f3397a683d656e9425f621050e243dc73ea03d", [("oldRate", "uint256", True), ("newRate", "uint256", True)]),
    "EIP712DomainChanged": ("0x0a6387c9ea3628b88a633bb4f3b151770f70085117a15f9bf3787cda53f13d31", []),
    "FeeChanged": ("0x5fc463da23c1b063e66f9e352006a7fbe8db7223c455dc429e881a2dfe2f94f1", [("oldFee", "uint256", True), ("newFee", "uint256", True)]),
    "FeeCharged": ("0xcd0d4a9ad4b364951764307d0ae7b0d2ea482965b258e2e2452ef396c53b20f0", [("fee", "uint256", True), ("userSignature", "bytes", False)]),
    "Initialized": ("0xc7f505b2f371ae2175ee4913f4499e1f2633a7b5936321eed1cdaeb6115181d2", [("version", "uint64", False)]),
    "MintProofConsumed": ("0x91f5c148b0f5ac9ddafe7030867f0d968adec49652c7ea760cf51fa233424b14", [("recipient", "address", True), ("payloadHash", "bytes32", True), ("payload", "bytes", False)]),
    "MinterUpdated": ("0xb21afb9ce9be0a676f8f317ff0ca072fb89a4f8ce2d1b6fe80f8755c14f1cb19", [("minter", "address", True), ("isMinter", "bool", False)]),
    "NameAndSymbolChanged": ("0x4d807d72b2a493ff2c4e338967d3f82d3352481258457d12a4506a1762a44c69", [("name", "string", False), ("symbol", "string", False)]),
    "OperatorRoleTransferred": ("0xd90d696290df8da2e089fb9f5467201dc45d6fa26d4d8e7c8a239b745f510c6c", [("previousOperator", "address", True), ("newOperator", "address", True)]),
    "OwnershipTransferStarted": ("0x38d16b8cac22d99fc7c124b9cd0de2d3fa1faef420bfe791d8c362d765e22700", [("previousOwner", "address", True), ("newOwner", "address", True)]),
    "OwnershipTransferred": ("0x8be0079c531659141344cd1fd0a4f28419497f9722a3daafe3b4186f6b6457e0", [("previousOwner", "address", True), ("newOwner", "address", True)]),
    "PairCreated": ("0x0d3648bd0f6ba80134a33ba9275ac585d9d315f0ad8355cddefde31afa28d0e9", [("token0", "address", True), ("token1", "address", True), ("pair", "address", False), ("n", "uint256", False)]),
    "Paused": ("0x62e78cea01bee320cd4e420270b5ea74000d11b0c9f74754ebdbfc544b05a258", [("account", "address", False)]),
    "PauserRoleTransferred": ("0xfb34c91b8734ef26ee8085a0fa11d2692042c6edac57dc40d8850cad2f1bc3ef", [("previousPauser", "address", True), ("newPauser", "address", True)]),
    "Swap": ("0xd78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822", [("sender", "address", True), ("amount0In", "uint256", False), ("amount1In", "uint256", False), ("amount0Out", "uint256", False), ("amount1Out", "uint256", False), ("to", "address", True)]),
    "Transfer": ("0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef", [("from", "address", True), ("to", "address", True), ("value", "uint256", False)]),
    "TreasuryAddressChanged": ("0x4fc6e7a37aea21888550b60360992adb6a9b3b4da644d63e9f3a420c2d86e282", [("prevValue", "address", True), ("newValue", "address", True)]),
    "Unpaused": ("0x5db9ee0a495bf2e6ff9c91a7834c1ba4fdd244a5e8aa4e537bd38aeae4b073aa", [("account", "address", False)]),
    "UnstakeRequest": ("0x48396c786750ed570cc1b02085ad1b3c1ffb59fd39686c23a263c1e0d974af1b", [("fromAddress", "address", True), ("scriptPubKey", "bytes", False), ("amount", "uint256", False)]),
    "WithdrawalsEnabled": ("0x45e7e6146471a396eb58b618e88efd46f5c95bd1815b282ed75c5220a559ab10", [("enabled", "bool", False)]),
}
